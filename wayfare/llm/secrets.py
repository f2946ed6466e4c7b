"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

Every token of a text is tagged begin, inside or outside. Features are the token's shape, the words around it, what
assigns to it, and the file's share of assignments and line lengths. All of them are sums over single tokens and offsets, so the emissions
of a text are a few table look-ups; a token that cannot be anything but outside in the best tagging, whatever its
rest of its word is (:meth:`Field.open`), ends a chain there, and Viterbi decodes the runs between. Plain words among plain words
are such tokens by a bound that is worked out for each field (:meth:`Field.safe`), so only surroundings of other tokens are
looked at (:func:`islands`). The tags are those of Viterbi over the whole text.

The field is trained on lines of a bounded sample of the documents (``MAX_TEXTS``, ``MAX_LINES``, by a hash), whose tags are
the values that the base patterns find, and on :func:`examples`, labelled lines of other forms of secrets and of what
resembles them. The patterns themselves are no features. Base spans always stay; the field's spans that overlap none are
added.

Defined cases: a null text is empty and has no spans; repeated rows are scanned alike; very long texts are scanned whole;
without documents the field is that of the examples; extra columns are ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import batches, quoted, sample_bound, sample_key, text

#: The base patterns and how long a match must be.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words that stand beside secrets, features of the field.
NEAR = "password passwd passphrase passcode pwd pass secret token apikey api_key api-key key bearer basic credential credentials auth authorization login pin private signature".split()
NEAR_IN = re.compile("|".join(sorted((w for w in NEAR if len(w) > 4), key=len, reverse=True)))

#: Marks of plain prose. A text of letters, blanks and these, without the words above, is plain.
QUOTES = "\"'`"
MARKS = ".,;!?()[]{}&#$%*<>\"'"
#: Words after one that is not plain whose tags it bears on, words before it, and words of context on either side of those.
AFTER, BEFORE, CONTEXT = 5, 1, 6

#: Sampled texts with a base pattern's words and without, lines of them that are trained on, tokens of such a line.
MAX_TEXTS, MAX_LINES, LINE_TOKENS = 1500, 1500, 40
EXAMPLES, HASHED = 3000, 1 << 13
#: Tokens whose features are kept by a task; when there are more it starts anew.
KNOWN = 1 << 20
ASCII_PLAIN = (string.ascii_letters + string.whitespace + MARKS).encode()
LETTER_BYTES = string.ascii_letters.encode() + bytes(range(128, 256))
TWO_MARKS = re.compile(rb"[%b]{2}" % re.escape(MARKS).encode())
#: Tokens of a plain word but its first.
MORE = 2
TOKEN = re.compile(r"([\w+/-]+|[^\w\s])")
LETTERS, WORD = re.compile(r"[^\W\d_]+"), re.compile(r"\S+")
OTHER = rf"[\d_]|[^\w\s{re.escape(MARKS)}]"
# digits, underscores, other marks, and words of two marks or more; so a plain word has at most three tokens
OTHER += rf"|(?<![^\W\d_])(?:[^\W\d_]*+[{re.escape(MARKS)}]){{2}}"
NOT_PLAIN, NOT_PLAIN_OR_NEAR = re.compile(OTHER), re.compile(OTHER + "|(?i:" + NEAR_IN.pattern + r"|(?<!\w)(?:" + "|".join(w for w in NEAR if len(w) <= 4) + r")(?!\w))")
OFFSETS = (-3, -2, -1, 1)
O, B, I = 0, 1, 2
#: What no tagging can make up for: an inside after an outside, or after white space.
BARRED = 1e4


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, ordered."""
    return sorted((s, k, e) for s, k, e, _ in _base(t))


def _base(t: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the base patterns."""
    low = t.lower()
    if any(h in low for h in HINTS):
        yield from ((m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6)
    if "AKIA" in t:
        yield from ((m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(t) if m.end() - m.start() >= 20)
    yield from ((m.start(), 2, m.end(), m.start()) for m in HEX.finditer(t))


def _h(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "replace")) % HASHED


def _bucket(n: int) -> int:
    return min(n // 4, 8)


def _letters(kinds: str, size: int, changes: int, name: str = "") -> tuple[str, str, str]:
    return f"{kinds}{size}", f"k{kinds} n{size} k{kinds}n{size} c{changes} h{name}", f"H{name}" if name else "w"


def _mark(w: str) -> tuple[str, str, str]:
    return "p", f"p p{w}", w if w in "=:@/`" else "p"


def plain() -> list[tuple[str, str, str]]:
    """The descriptions of plain tokens."""
    words = [_letters(k, n, c) for k in ("a", "A", "T", "aA") for n in range(9) for c in range(7 if k == "aA" else 1)]
    return words + [_mark(m) for m in MARKS]


def islands(t: str) -> list[tuple[int, int, int, int]]:
    """(start, end, first and last end of what may be tagged) of the parts of a text around tokens that are not plain."""
    low = t.lower()
    search = NOT_PLAIN_OR_NEAR if any(w in low for w in NEAR) else NOT_PLAIN
    # texts without any are most: a look at what letters leave settles them
    data = t.encode("utf-8", "surrogatepass")
    rare = data.translate(None, ASCII_PLAIN).decode("utf-8", "surrogatepass")
    if search is NOT_PLAIN and not (rare and NOT_PLAIN.search(rare)) and not TWO_MARKS.search(data.translate(None, LETTER_BYTES)):
        return []
    at = np.array([m.span() for m in WORD.finditer(t)])
    hit = np.array([m.start() for m in search.finditer(t)])
    core = np.zeros(len(at) + 1, np.int64)
    hit = np.unique(np.searchsorted(at[:, 0], hit, side="right") - 1)
    np.add.at(core, np.maximum(hit - BEFORE, 0), 1)
    np.add.at(core, np.minimum(hit + AFTER + 1, len(at)), -1)
    first = np.flatnonzero(np.diff(np.concatenate(([False], np.cumsum(core)[:-1] > 0, [False])).astype(np.int8))).reshape(-1, 2)
    out: list[list[int]] = []
    for i, j in first.tolist():
        lo, hi = max(0, i - CONTEXT), min(len(at), j + CONTEXT)
        if out and lo <= out[-1][1]:
            out[-1][1], out[-1][3] = hi, j
        else:
            out.append([lo, hi, i, j])
    return [(int(at[lo, 0]), int(at[hi - 1, 1]), int(at[i, 0]), int(at[j - 1, 1])) for lo, hi, i, j in out]


def describe(w: str) -> tuple[str, str, str]:
    """(its class, its own features joined by blanks, its name to neighbours) of a token; few differ among plain words."""
    low = w.lower()
    name = low if low in NEAR else m.group() if (m := NEAR_IN.search(low)) else ""
    if LETTERS.fullmatch(w):
        kinds = "a" if w.islower() else "A" if w.isupper() else "T" if w[1:].islower() else "aA"
        return _letters(kinds, _bucket(len(w)), min(sum(a.isupper() != b.isupper() for a, b in zip(w, w[1:])), 6) if kinds == "aA" else 0, name)
    if len(w) == 1 and not w.isalnum():
        return _mark(w)
    kinds = "".join(sorted({"9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "-_/+" else "?" for c in w}))
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in w[:64]))[:8]
    hexed = all(c in "0123456789abcdef" for c in w)
    turns = min(sum(a.isdigit() != b.isdigit() for a, b in zip(w, w[1:])), 6)
    own = f"k{kinds} s{shape} n{_bucket(len(w))} k{kinds}n{_bucket(len(w))} x{hexed}{kinds}{len(w) >= 20} d{len(set(w)) * 4 // min(len(w), 16)}{kinds} t{turns}{kinds} h{name}"
    return f"{kinds}{_bucket(len(w))}", own, f"H{name}" if name else f"x{kinds}"


def file_features(t: str) -> tuple[str, str]:
    n = max(len(t), 1)
    return f"eq{min(3, t.count('=') * 2000 // n)}", f"line{min(3, n // (t.count(chr(10)) + 1) // 60)}"


#: What letters and marks are described as where nothing before them suggests a secret.
QUIET = ("q", "q", "q")


class _Signs(dict):
    """token -> number of its description. Descriptions are few; what each adds to emissions is worked out once."""

    def __init__(self) -> None:
        super().__init__()
        self.number: dict[tuple, int] = {QUIET: 0}
        self.all: list[tuple[str, str, str]] = [QUIET]

    def __missing__(self, w: str) -> int:
        d = describe(w)  # descriptions are few
        n = self.number.get(d)
        if n is None:
            n = self.number[d] = len(self.all)
            self.all.append(d)
        self[w] = n
        return n


def tokens(t: str, signs: _Signs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of the description, whether nothing stands before it) of each token."""
    parts = TOKEN.split(t)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(size)
    words = parts[1::2]
    if len(signs) > KNOWN:
        signs.clear()
    sign = np.fromiter(map(signs.__getitem__, words), np.int64, len(words))
    end = ends[1::2]
    return end - size[1::2], end, sign, size[:-1:2][: len(words)] == 0


def _back(a: np.ndarray, k: int) -> np.ndarray:
    """a moved by k places, False where nothing comes in."""
    out = np.zeros_like(a)
    if k < len(a):
        out[k:] = a[: len(a) - k]
    return out


def contexts(sign: np.ndarray, glued: np.ndarray, hint: np.ndarray, equal: np.ndarray, quote: np.ndarray) -> np.ndarray:
    """What stands before each token: 1 an assignment to a word of NEAR, 2 the same in quotes, 3 such a word, 4 one further off,
    5 another assignment, 6 it continues the token before, 0 none of these."""
    h, e, q = hint[sign], equal[sign], quote[sign]
    to = _back(e, 1) & (_back(h, 2) | (_back(q, 2) & _back(h, 3)) | (_back(e, 2) & _back(h, 3)))
    far = _back(h, 2) | _back(h, 3) | _back(h, 4) | _back(h, 5)
    code = np.zeros(len(sign), np.int64)
    code[glued] = 6
    code[_back(e, 1)] = 5
    code[far] = 4
    code[_back(h, 1)] = 3
    code[_back(q, 1) & _back(to, 1)] = 2
    code[to] = 1
    return code * 2 + glued


CONTEXTS = 14
#: Contexts without a word of NEAR or an assignment: nothing before, and the same after a token that ends there.
NEUTRAL = np.isin(np.arange(CONTEXTS), (0, 1, 12, 13))


def quietened(sign: np.ndarray, code: np.ndarray, plain_: np.ndarray) -> np.ndarray:
    """sign, but plain tokens in neutral contexts are the quiet one."""
    return np.where(NEUTRAL[code] & plain_[sign], 0, sign)


def is_plain(d: tuple[str, str, str]) -> bool:
    return d[2] == "w" or d[0] == "p" and d[1][-1] in MARKS


def own_names(d: tuple[str, str, str]) -> list[str]:
    return ["1", *(f"o{x}" for x in d[1].split(" "))]


def near_rows(k: int, d: tuple[str, str, str]) -> int:
    """The row of weights of a token to one k places before it or after; plain tokens say nothing to their neighbours."""
    return HASHED if d[2] in ("w", "p", "q") else _h(f"{k}|{d[2]}")


@dataclass
class Field:
    """Weights of (feature, tag) and of tag pairs; a field without weights tags nothing."""

    emit: np.ndarray | None
    trans: np.ndarray | None
    _kept: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"emit": self.emit, "trans": self.trans, "_kept": {}}

    def _tables(self) -> dict:
        """What each description adds to the emissions, for the descriptions known so far."""
        k = self._kept
        if not k:
            k.update(signs=_Signs(), own=np.zeros((0, 3)), near={o: np.zeros((0, 3)) for o in OFFSETS}, kind=np.zeros(0, np.int64), kinds={}, files={}, conj=np.zeros((CONTEXTS, 0, 3)), hint=np.zeros(0, bool), equal=np.zeros(0, bool), quote=np.zeros(0, bool), plain=np.zeros(0, bool))
        return k

    def _grow(self, k: dict) -> None:
        new = k["signs"].all[len(k["own"]) :]
        if not new:
            return
        k["own"] = np.concatenate((k["own"], [self.emit[[_h(x) for x in own_names(d)]].sum(axis=0) for d in new]))
        for o in OFFSETS:
            k["near"][o] = np.concatenate((k["near"][o], [self.emit[near_rows(o, d)] for d in new]))
        k["kind"] = np.concatenate((k["kind"], np.array([k["kinds"].setdefault(d[0], len(k["kinds"])) for d in new], np.int64)))
        k["hint"] = np.concatenate((k["hint"], [d[2][:1] == "H" for d in new]))
        k["equal"] = np.concatenate((k["equal"], [d[2] in ("=", ":") for d in new]))
        k["quote"] = np.concatenate((k["quote"], [d[1][-1] in QUOTES and d[0] == "p" for d in new]))
        k["plain"] = np.concatenate((k["plain"], [is_plain(d) for d in new]))
        names = list(k["kinds"])[k["conj"].shape[1] :]
        if names:
            k["conj"] = np.concatenate((k["conj"], np.array([[self.emit[_h(f"c{c}|{x}")] for x in names] for c in range(CONTEXTS)])), axis=1)
            k["files"].clear()

    def emissions(self, t: str, of: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, emissions, whether nothing stands before) of the tokens of a part of a text whose file features are given."""
        k = self._tables()
        start, end, sign, glued = tokens(t, k["signs"])
        self._grow(k)
        code = contexts(sign, glued, k["hint"], k["equal"], k["quote"])
        own = quietened(sign, code, k["plain"])
        e = k["own"][own]
        n = len(sign)
        for o in OFFSETS:
            if o < 0:
                e[-o:] += k["near"][o][sign[: max(n + o, 0)]]
            else:
                e[: max(n - o, 0)] += k["near"][o][sign[o:]]
        kind = k["kind"][own]
        e += k["conj"][code, kind]
        if of not in k["files"]:
            k["files"][of] = np.array([self.emit[_h(f"{of[0]}|{x}")] + self.emit[_h(f"{of[1]}|{x}")] for x in k["kinds"]])
        e += k["files"][of][kind]
        e[~glued, I] -= BARRED
        return start, end, e, glued

    def _costs(self) -> tuple[float, float]:
        """The most that the transitions of a begin and of an inside bring, less those of outside tokens in their place."""
        t = self.trans
        begin = t[O, B] - t[O, O] + max(t[B, O] - t[O, O], t[B, B] - t[O, B], t[B, I] - t[O, O])
        return begin, max(t[I, O] - t[O, O], t[I, B] - t[O, B], t[I, I] - t[O, O])

    def safe(self) -> bool:
        """Whether plain tokens among plain tokens are outside in any best tagging.

        No run goes on into another word, so it is if a begin costs more than the transitions and the rest of its word can
        bring, by the greatest sums of the tables over plain tokens.
        """
        k = self._tables()
        if "safe" not in k:
            gain = lambda names: (lambda v: v[[B, I]] - v[O])(self.emit[[_h(x) for x in names]].sum(axis=0))
            most = lambda many: np.max([gain(x) for x in many], axis=0)
            rest = gain(own_names(QUIET)) + most([[f"eq{i}|q", f"line{j}|q"] for i in range(4) for j in range(4)])
            loose, glued = (rest + most([[f"c{c}|q"] for c in cs]) for cs in ((0, 12), (1, 13)))
            begin, inside = self._costs()
            go_on = MORE * max(0, glued[1] + inside)
            k["margin"] = max(loose[0], glued[0]) + begin + go_on
            k["safe"] = bool(k["margin"] < 0)
        return k["safe"]

    def open(self, e: np.ndarray, glued: np.ndarray) -> np.ndarray:
        """Tokens of the words that may have other tags than outside in the best tagging.

        A run of other tags begins in a word and ends in it. It is better outside if its begin, and all that insides up to
        the end of the word can bring, sum to less than nothing.
        """
        begin, inside = self._costs()
        word = np.cumsum(~glued)
        gain = np.maximum(0, e[:, I] - e[:, O] + inside) * glued
        upto = np.cumsum(gain)
        last = np.flatnonzero(np.append(word[1:] != word[:-1], True))
        rest = upto[last][word - word[0]] - upto
        may = e[:, B] - e[:, O] + begin + rest >= 0
        return np.isin(word, word[may]) if may.any() else may

    def spans(self, t: str, whole: bool = False) -> list[tuple[int, int]]:
        """Spans of the best tag sequence; with ``whole`` Viterbi runs over all tokens at once, which gives the same."""
        if self.emit is None or not t:
            return []
        parts = islands(t) if not whole and self.safe() else [(0, len(t), 0, len(t))]
        out: list[tuple[int, int]] = []
        of = file_features(t) if parts else ("", "")
        for at, to, lo, hi in parts:
            start, end, e, glued = self.emissions(t[at:to], of)
            if not len(e):
                continue
            may = np.ones(len(e), bool) if whole else self.open(e, glued) & (start >= lo - at) & (end <= hi - at)
            edge = np.flatnonzero(np.diff(np.concatenate(([False], may, [False])).astype(np.int8)))
            for i, j in edge.reshape(-1, 2).tolist():
                for k, tag in enumerate(_viterbi(e[i:j], self.trans), i):
                    if tag == B:
                        out.append((at + int(start[k]), at + int(end[k])))
                    elif tag == I:
                        out[-1] = (out[-1][0], at + int(end[k]))
        return out


def _viterbi(e: np.ndarray, trans: np.ndarray) -> list[int]:
    """The best tags of a chain between outside tokens."""
    t, back = trans.tolist(), []
    score = t[O]
    for k, x in enumerate(e.tolist()):
        if k:
            paths = [max((score[p] + t[p][n], -p) for p in (O, B, I)) for n in (O, B, I)]
            back.append([-p for _, p in paths])
            score = [v + y for (v, _), y in zip(paths, x)]
        else:
            score = [v + y for v, y in zip(score, x)]
    tags = [max((O, B, I), key=lambda n: score[n] + t[n][O])]
    for b in reversed(back):
        tags.append(b[tags[-1]])
    return tags[::-1]


def _chain(t: str, values: list[tuple[int, int]], of_file: tuple[str, str], signs: _Signs, most: int = LINE_TOKENS) -> tuple[list[int], list[list[int]], list[int], list[bool]]:
    """(descriptions, other features, tags, whether nothing stands before) of a line's tokens, of as many as a training line may have: those around its first
    value, or the first."""
    start, end, sign, glued = tokens(t, signs)
    d = [signs.all[k] for k in sign.tolist()]
    flag = lambda f: np.array([f(x) for x in signs.all], bool)
    code = contexts(sign, glued, flag(lambda x: x[2][:1] == "H"), flag(lambda x: x[2] in ("=", ":")), flag(lambda x: x[0] == "p" and x[1][-1] in QUOTES)).tolist()
    tags, n = [O] * len(d), len(d)
    for lo, hi in values:
        inside = [k for k in range(n) if start[k] >= lo and end[k] <= hi]
        for k in inside:
            tags[k] = I if glued[k] and k != inside[0] else B
    first = next((k for k in range(n) if tags[k]), 0)
    lo = max(0, min(first - most // 2, n - most))
    while lo and tags[lo] == I:
        lo -= 1
    part = range(lo, min(lo + most, n))
    own = quietened(sign, np.array(code, np.int64), flag(is_plain)).tolist()
    near = [[near_rows(o, d[k + o]) if 0 <= k + o < n else HASHED for o in OFFSETS] for k in part]
    more = [[_h(f"c{code[k]}|{signs.all[own[k]][0]}"), *(_h(f"{f}|{signs.all[own[k]][0]}") for f in of_file)] for k in part]
    return own[lo : lo + most], [a + b for a, b in zip(near, more)], tags[lo : lo + most], glued[lo : lo + most].tolist()


def fit(lines: list[tuple[str, list[tuple[int, int]], tuple[str, str]]], rounds: int = 80, rate: float = 0.5, l2: float = 2e-5) -> Field:
    """Maximum likelihood by scaled forward and backward sums over lines (text, spans of its secrets, features of its file).

    Chains are sorted by length, so that a step works on those that reach it, the first rows.
    """
    signs = _Signs()
    chains = sorted((c for t, v, f in lines if (c := _chain(t, v, f, signs))[2]), key=lambda c: -len(c[2]))
    if not any(any(t) for _, _, t, _ in chains):
        return Field(None, None)
    c, n = len(chains), len(chains[0][2])
    own = [[_h(x) for x in own_names(d)] for d in signs.all]
    wide = max(map(len, own))
    own = np.array([x + [HASHED] * (wide - len(x)) for x in own])  # the row beyond the weights stands for no feature
    length = np.array([len(c[2]) for c in chains])
    reach = [int((length > s).sum()) for s in range(n)]
    live = np.arange(n)[None] < length[:, None]
    sign = np.array([v for c in chains for v in c[0]])
    other = np.array([v for c in chains for v in c[1]])
    loose = ~np.array([v for c in chains for v in c[3]])
    y = np.zeros((c, n), np.int64)
    y[live] = [v for c in chains for v in c[2]]
    said = np.eye(3)[y[live]]
    emit, trans = np.zeros((HASHED + 1, 3)), np.zeros((3, 3))
    steps = [np.zeros_like(emit) + 1e-8, np.zeros_like(trans) + 1e-8]
    may = np.ones((3, 3))
    may[O, I] = 0
    rows, last = np.arange(c), length - 1
    count = np.zeros((3, 3))
    np.add.at(count, (O, y[:, 0]), 1)
    np.add.at(count, (y[rows, last], O), 1)
    for s in range(1, n):
        np.add.at(count, (y[: reach[s], s - 1], y[: reach[s], s]), 1)
    for _ in range(rounds):
        of_sign = emit[own].sum(axis=1)
        e = np.ones((c, n, 3))
        x = of_sign[sign] + emit[other].sum(axis=1)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        x[loose, I] = 0
        e[live] = x
        m = np.exp(trans) * may
        alpha, scale = np.zeros((c, n, 3)), np.ones((c, n, 1))
        for s in range(n):
            r = reach[s]
            a = (m[O][None] if s == 0 else alpha[:r, s - 1] @ m) * e[:r, s]
            scale[:r, s] = a.sum(axis=1, keepdims=True)
            alpha[:r, s] = a / scale[:r, s]
        beta = np.zeros((c, n, 3))
        beta[rows, last] = m[:, O]
        pairs = np.zeros((3, 3))
        for s in range(n - 2, -1, -1):
            r = reach[s + 1]
            ahead = e[:r, s + 1] * beta[:r, s + 1] / scale[:r, s + 1]
            beta[:r, s] = ahead @ m.T
            z = (alpha[:r, s] * beta[:r, s]).sum(axis=1, keepdims=True)
            pairs += (alpha[:r, s] / z).T @ ahead * m
        p = alpha * beta
        p = p[live] / p[live].sum(axis=1, keepdims=True)
        diff = (said - p) / c
        ge = np.zeros_like(emit)
        for tag in range(3):
            by_sign = np.bincount(sign, diff[:, tag], len(own))
            ge[:, tag] = np.bincount(own.ravel(), np.repeat(by_sign, wide), HASHED + 1) + np.bincount(other.ravel(), np.repeat(diff[:, tag], other.shape[1]), HASHED + 1)
        ge[HASHED] = 0
        full = np.zeros((c, n, 3))
        full[live] = p
        pairs[O] += full[:, 0].sum(axis=0)
        pairs[:, O] += full[rows, last].sum(axis=0)
        for w, g, h in ((emit, ge - l2 * emit, steps[0]), (trans, (count - pairs) / c - l2 * trans, steps[1])):
            h += g * g
            w += rate * g / np.sqrt(h)
    return Field(emit, np.where(may > 0, trans, -BARRED))


def examples(n: int = EXAMPLES, seed: int = 1) -> list[tuple[str, list[tuple[int, int]], tuple[str, str]]]:
    """Labelled lines: secrets of letters, of digits, short ones, with symbols, in words, behind key words, prefixes and in
    addresses; and lines with the same words, numbers and addresses that hold none. A rule with a seed, no data."""
    r = random.Random(seed)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    text_of = lambda alphabet, lo, hi: "".join(r.choice(alphabet) for _ in range(r.randint(lo, hi)))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "é", "ç", "ün")) for _ in range(r.randint(1, 4)))
    camel = lambda w: "".join(r.choice((str.upper, str.lower))(c) for c in w)
    styles = (str.lower, str.lower, str.lower, str.lower, str.capitalize, str.upper, camel)
    prose = lambda lo, hi: (lambda style, mark: " ".join((style if r.random() < 0.7 else r.choice(styles))(word()) + (r.choice((",", ".", mark, mark * 3, f"{mark}{mark}", f"({word()})")) if r.random() < 0.3 else "") for _ in range(r.randint(lo, hi))))(r.choice(styles), r.choice(MARKS))
    letters = lambda: r.choice((text_of(low, 6, 20), text_of(low + low.upper(), 6, 24), text_of(low.upper(), 6, 20)))
    mixed = lambda: text_of(low + low.upper() + digits, 6, 40)
    symbols = lambda: text_of(low, 1, 4) + "".join(r.choice("@!#$%^&*") + text_of(low + low.upper() + digits, 1, 5) for _ in range(r.randint(1, 4)))
    words = lambda: r.choice("-_").join(text_of(low, 3, 8) for _ in range(r.randint(3, 5)))
    hexed = lambda: r.choice((text_of("0123456789abcdef", 12, 64), "-".join(text_of("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))))
    coded = lambda: text_of(low + low.upper() + digits + "+/", 20, 60) + r.choice(("", "=", "=="))
    any_value = lambda: r.choice((letters, mixed, mixed, symbols, words, hexed, coded, lambda: text_of(digits, 4, 12)))()
    strong = lambda: r.choice((mixed, symbols, hexed, coded))()
    near = lambda: "".join(r.choice((str.lower, str.lower, str.upper, str.capitalize))(r.choice(("", "", "my_", "db_", "client_", "aws-", "x-")) + w) for w in [r.choice([x for x in NEAR if x not in ("bearer", "basic", "private", "signature")])])
    out = []
    for _ in range(n):
        before, after = prose(0, 12), prose(0, 12)
        kind, value = r.random(), ""
        if kind < 0.22:
            value = any_value()
            mark = r.choice(("", "", '"', "'", "`"))
            mid = f"{near()}{r.choice(('=', ': ', ' = ', ':', ' := ', '=', ' => '))}{mark}\0{mark}"
        elif kind < 0.32:
            value = strong()
            mid = f"{near()}{r.choice((' is ', ' ', ' was set to ', ' -> ', ' for the server is ', ' here '))}\0"
        elif kind < 0.40:
            value = r.choice((strong, mixed, coded, letters))()
            mid = r.choice(("Authorization: Bearer \0", "authorization: Basic \0", "Bearer \0", "curl -H 'Authorization: token \0'", "--password \0", "-p \0 --login"))
        elif kind < 0.47:
            value = r.choice((any_value, strong))().replace("/", "x").replace("@", "!").replace(":", "")
            mid = f"{r.choice(('postgres', 'https', 'redis', 'mysql', 'ftp'))}://{text_of(low, 3, 8)}:\0@{text_of(low, 3, 8)}.{r.choice(('com', 'net', 'local'))}"
        elif kind < 0.53:
            value = f"{text_of(low, 2, 4)}_{r.choice(('', 'live_', 'test_', 'pat_'))}{text_of(low + low.upper() + digits, 20, 40)}"
            mid = "\0"
        elif kind < 0.68:  # key words without a secret
            mid = f"{near()} {r.choice(('was changed', 'is required', 'must be set', 'for the', 'of', 'to the', 'and the', 'is wrong', 'expired', 'in the', 'is'))} {prose(1, 4)}"
        elif kind < 0.72:
            mid = f"{r.choice(('note', 'name', 'title', 'chapter', 'x', 'width', 'lang', 'mode', 'author', 'color'))}{r.choice(('=', ': ', ' = '))}{r.choice((word(), text_of(digits, 1, 6), prose(1, 2)))}"
        elif kind < 0.90:  # numbers and addresses
            mid = r.choice((
                lambda: f"+{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), lambda: f"{word()}.{r.randint(0, 99)}@mail{r.randint(0, 9)}.example.com",
                lambda: text_of(digits, 1, 19), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23)}:{r.randint(10, 59)}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 9)}",
                lambda: f"https://www.{word()}.com/{word()}/{word()}-{word()}-{r.randint(1, 99)}.html", lambda: f"{word()}{r.choice(('$$$', '%%%', '***', '&&&', '###', '!!'))} {word()}{r.choice(('$$$', '%%%', '***'))}", lambda: f"{r.choice(('Version', 'GPL', 'BY', 'ISO', 'RFC'))} {r.randint(1, 9)}.{r.randint(0, 9)}",
                lambda: f"{word()}-{word()}-{word()}", lambda: f"{word()}_{word()}({word()}, {r.randint(0, 99)})", lambda: f"#{text_of('0123456789abcdef', 6, 6)}", lambda: f"{word().upper()} {word().upper()},",
            ))()
        else:
            mid = prose(3, 20)
        line = f"{before} {mid} {after}".strip()
        at = line.find("\0")
        spans = [(at, at + len(value))] if value else []
        out.append((line.replace("\0", value), spans, (f"eq{r.choice((0, 0, 0, 1, 2, 3))}", f"line{r.randint(0, 3)}")))
    return out


def _lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, key, line, spans, eq, line length) of the lines of texts: those that hold values first, by a hash in each rank."""
    import xxhash

    for b in it:
        rows = []
        for t in b.column(0).to_pylist():
            values = sorted({(v, e) for _, _, e, v in _base(t)})
            of = file_features(t)
            for m in re.finditer(r"[^\n]+", t):
                own = [(v - m.start(), e - m.start()) for v, e in values if m.start() <= v and e <= m.end()]
                line = m.group()
                if own and own[0][0] > 2000 or len(line) > 4000:  # a long line: what is around its first value, or its beginning
                    cut = max(0, own[0][0] - 2000) if own else 0
                    own = [(v - cut, e - cut) for v, e in own if v >= cut and e <= cut + 4000]
                    line = line[cut : cut + 4000]
                rows.append((0 if own else 1, xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) >> 1, line, [x for s in own for x in s], *of))
        cols = list(zip(*rows)) or [()] * 6
        kinds = (pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["rank", "key", "t", "spans", "eq", "len"])


def train(docs: DataFrame, column: str = "text", rounds: int = 80) -> Field:
    """A field from the examples and from at most MAX_LINES lines each with and without base values, of about MAX_TEXTS texts
    each with and without the words of the base patterns, chosen by hashes."""
    batches(docs.sparkSession)
    words = r"AKIA|[0-9a-f]{24}|(?i)(?:password|passwd|secret|token|api_?key)"
    d = docs.select(text(column).alias("t")).where("t <> ''").select("t", F.col("t").rlike(words).alias("likely"), F.xxhash64("t").alias("h")).withColumn("key", sample_key("h"))
    n = {r[0]: r[1] for r in d.groupBy("likely").count().collect()}
    near = F.when(F.col("likely"), F.lit(sample_bound(n.get(True, 0), MAX_TEXTS))).otherwise(F.lit(sample_bound(n.get(False, 0), MAX_TEXTS)))
    lines = d.where(F.col("key") < near).select("t").mapInArrow(_lines, "rank int, key long, t string, spans array<int>, eq string, len string")
    rows = []
    for rank in (0, 1):
        rows += lines.where(F.col("rank") == rank).distinct().orderBy("key", "t").limit(MAX_LINES).collect()
    own = [(r.t, list(zip(r.spans[::2], r.spans[1::2])), (r.eq, r.len)) for r in rows]
    return fit(own + examples(), rounds)


def all_spans(t: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and added spans), each (start, kind, end) and ordered."""
    base = base_spans(t)
    more = [(s, 3, e) for s, e in field.spans(t) if not any(a < e and s < b for a, _, b in base)]
    return base, sorted(base + more)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, field: Field, id_column: str = "doc_id", column: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_crf) for every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast(field)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = held.value
        for b in it:
            got = [all_spans(t, f) for t in b.column(1).to_pylist()]
            counts = [[sum(k == kind for _, k, _ in every) for _, every in got] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in got], pa.string()), pa.array([_said(every) for _, every in got], pa.string()), pa.array(counts[3], pa.int64())],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

    batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text(column).alias("t")).mapInArrow(run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def redact(docs: DataFrame, field: Field, column: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of its text replaced by ``mark``; null texts stay null, rows and columns stay."""
    held = docs.sparkSession.sparkContext.broadcast(field)
    names, at = docs.columns, docs.columns.index(column)
    inner = [f"c{i}" for i in range(len(names))]

    def clean(t: str | None) -> str | None:
        if not t:
            return t
        out, end = [], 0
        for s, _, e in all_spans(t, held.value)[1]:
            if s >= end:
                out += [t[end:s], mark]
            end = max(end, e)
        return "".join(out) + t[end:] if out else t

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            cols = list(b.columns)
            cols[at] = pa.array([clean(t) for t in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, inner)

    batches(docs.sparkSession)
    rows = docs.select(*[quoted(c).alias(i) for c, i in zip(names, inner)])
    return rows.mapInArrow(run, rows.schema).toDF(*names)
