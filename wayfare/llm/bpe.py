"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Each task pre-tokenizes its documents in chunks of bounded size. Texts are cut at blanks where no match can go across,
   and each distinct piece of a chunk is searched once. A chunk's distinct words get local numbers in the order of their
   pieces; every pre-token leaves its word's number at its position. One scan gives the distinct words of each chunk,
   another the positions of each document, which so never travel with the words.
2. Distinct words are dealt out by a hash bucket, sorted by bucket, and each is merged once where its bucket lies, a batch
   of words together. Only distinct words of a chunk travel, so a word that is a twentieth of all pre-tokens costs one row
   part per chunk.
3. Ids go back to their chunk, and each document is put together by position. Decoding looks each id up in the table of
   token bytes, whose size the vocabulary fixes.

A chunk is named by its task and its number there, and goes to a partition by that name: chunks are dealt out evenly, and
copies of a chunk are chunks of their own. Partitions grow with the input, so none grows with it.

Defined cases: a null text is an empty text; an empty text has no tokens; repeated rows and ids are encoded row by row;
one very long document makes one chunk of its own; extra columns are ignored. docs must read alike on both scans, as a
table does; chunks carry a digest of their texts, and one that changed between the scans raises an error. Special tokens
are never produced: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import batches, input_bytes, text

#: Bytes of a chunk, and word buckets for each shuffle partition.
CHUNK_BYTES, BUCKETS_EACH = 16 << 20, 4
#: Input bytes, by Spark's statistics, for each shuffle partition, where that asks for more than spark.sql.shuffle.partitions.
PARTITION_BYTES = 32 << 20
#: Longer words are merged one by one; words that are merged together.
LONG, TOGETHER = 48, 1 << 14
#: A pattern that begins with English clitics says the same with them behind the words: no word begins with an apostrophe.
CLITICS, WORDS = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|", " ?\\p{L}++|'(?:s|t|re|ve|m|ll|d)|"
#: What follows them in the pattern whose texts are searched in pieces; for any other pattern they are searched whole.
OTHERS = " ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"
#: White space by any definition, and blanks that have none before them.
SPACES = "[\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
CUTS = re.compile(f" (?<!{SPACES} )")
#: Letters in every version of Unicode: with its blank such a piece is one match.
LETTERS = "^[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+$"


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a ranks file: base64, blank, number in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of lowest rank is merged until no pair has one; leftmost first among equals."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > 64:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """As merge_word, with a heap and a linked list, for words of any length."""
    import heapq

    n = len(parts)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        if not alive[i] or (j := nxt[i]) >= n or parts[i] + parts[j] != both:
            continue
        parts[i], alive[j], nxt[i] = both, False, nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
            if (r := ranks.get(both + parts[nxt[i]])) is not None:
                heapq.heappush(heap, (r, i, both + parts[nxt[i]]))
        if prv[i] >= 0 and (r := ranks.get(parts[prv[i]] + both)) is not None:
            heapq.heappush(heap, (r, prv[i], parts[prv[i]] + both))
    return [ranks[p] for p, a in zip(parts, alive) if a]


class Merger:
    """Merges many words together: one numpy step merges the best pair of each word that has one."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.none = np.int64(1 << 62)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((b >= 0) & (self.keys[at] == key), self.rank[at], self.none)

    def _merged(self, words: list[bytes]) -> list[list[int]]:
        """Words of 2 to LONG bytes, none a token, of like lengths."""
        n, width = len(words), max(map(len, words))
        size = np.array([len(w) for w in words])
        ids = np.full((n, width + 1), -1, np.int64)
        ids[np.arange(width + 1)[None] < size[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((n, width + 1), self.none)
        rank[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        left, place = np.arange(n), np.arange(width + 1)
        x, r = ids, rank
        while True:
            at = r.argmin(axis=1)
            best = r[np.arange(len(r)), at]
            live = best < self.none
            if not live.all():
                ids[left[~live]] = x[~live]
                left, x, r, at, best = left[live], x[live], r[live], at[live], best[live]
            if not len(left):
                break
            # all behind the merged pair move up by one
            take = np.minimum(place[None] + (place[None] > at[:, None]), width)
            x, r = np.take_along_axis(x, take, 1), np.take_along_axis(r, take, 1)
            rows = np.arange(len(left))
            x[rows, at] = best
            x[:, width] = -1
            r[rows, at] = self._ranks(best, x[rows, np.minimum(at + 1, width)])
            before = np.flatnonzero(at > 0)
            r[before, at[before] - 1] = self._ranks(x[before, at[before] - 1], best[before])
        count = (ids >= 0).sum(axis=1).tolist()
        return [row[:c] for row, c in zip(ids.tolist(), count)]

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = {}
        rest = []
        for w in words:
            if (i := self.ranks.get(w)) is not None:
                out[w] = [i]
            elif len(w) > LONG:
                out[w] = merge_word(w, self.ranks)
            else:
                rest.append(w)
        rest.sort(key=len)
        for k in range(0, len(rest), TOGETHER):
            part = rest[k : k + TOGETHER]
            out.update(zip(part, self._merged(part)))
        return out


def packs(numbers: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Numbers under 2**35 as base-128 digits, low first, the last without the high bit: a value for each part, as they end at ``ends``."""
    v = numbers.astype(np.uint64)
    cols = next((k for k in range(1, 5) if not len(v) or v.max() < 1 << 7 * k), 5)
    size = np.ones(len(v), np.int64)
    digits = np.empty((len(v), cols), np.uint8)
    for k in range(cols):
        digits[:, k] = (v >> np.uint64(7 * k)).astype(np.uint8) & 127
        if k:
            size += v >= np.uint64(1 << 7 * k)
    col = np.arange(cols)
    digits |= (col < size[:, None] - 1).astype(np.uint8) << 7
    out = digits[col < size[:, None]].tobytes()
    to = np.concatenate(([0], np.cumsum(size)))[ends].tolist()
    return [out[i:j] for i, j in zip([0, *to], to)]


def pack(numbers: np.ndarray) -> bytes:
    """Numbers as one part."""
    return packs(numbers, np.array([len(numbers)]))[0]


def unpack(data: bytes) -> np.ndarray:
    """What pack() was given; parts that stand one behind the other give all their numbers."""
    d = np.frombuffer(data, np.uint8)
    if not len(d) or d.max() < 128:
        return d.astype(np.int64)
    last = np.flatnonzero(d < 128)
    start = np.concatenate(([0], last[:-1] + 1))
    v = (d[start] & 127).astype(np.int64)
    for k in range(1, int((last - start).max()) + 1):
        more = np.flatnonzero(last - start >= k)
        v[more] |= (d[start[more] + k] & 127).astype(np.int64) << (7 * k)
    return v


def _joined(values: pa.Array, ends: np.ndarray) -> pa.Array:
    """Values of large types joined in parts that end at ``ends``."""
    if not len(values):
        return pa.array([b""] * len(ends), pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets[np.concatenate(([0], ends))]), values.buffers()[2]])


def _chunks(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Documents (keys, texts) in chunks of about CHUNK_BYTES."""
    parts: list[pa.RecordBatch] = []
    size = 0
    whole = lambda: tuple(pa.concat_arrays([p.column(i) for p in parts]) for i in (0, 1))
    for b in it:
        begin = 0
        for i, n in enumerate(pc.binary_length(b.column(1)).to_pylist()):
            size += n
            if size >= CHUNK_BYTES:
                parts.append(b.slice(begin, i + 1 - begin))
                yield whole()
                parts, size, begin = [], 0, i + 1
        if begin < b.num_rows:
            parts.append(b.slice(begin))
    if parts:
        yield whole()


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(pieces, number of pieces of each text, order of the texts): texts cut at, and without, the blanks that follow no white space.

    No match holds a blank behind other characters, and none asks for what stands before it, so the matches of the pieces,
    each with its blank again, are those of the text. Texts with other blanks come last.
    """
    odd = pc.match_substring_regex(texts, SPACES + " ")
    plain = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
    cut = [CUTS.split(t) for t in texts.filter(odd).to_pylist()]
    odd = odd.to_numpy(zero_copy_only=False)
    n = np.concatenate((pc.list_value_length(plain).to_numpy(), np.array([len(x) for x in cut], np.int32)))
    return pa.concat_arrays([plain.flatten(), pa.array(chain.from_iterable(cut), texts.type)]), n, np.argsort(odd, kind="stable")


def _searched(texts: pa.Array, find, apart: bool) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of the distinct pieces, distinct piece at each place, number of words of each, number of places of each text, order of the texts).

    Distinct pieces within texts are found in one search; both ends of a text, which may hold white space, each in its own.
    """
    pieces, n, order = _pieces(texts) if apart else (texts, np.ones(len(texts), np.int64), np.arange(len(texts)))
    first = np.cumsum(n) - n
    last = (first + n - 1)[n > 1]
    inner = np.ones(len(pieces), bool)
    inner[first] = inner[last] = False
    inside = pieces.filter(pa.array(inner)).dictionary_encode()
    outside = pa.concat_arrays([pieces.take(pa.array(first)), pc.binary_join_element_wise("", pieces.take(pa.array(last)), " ")]).dictionary_encode()
    plain = pc.match_substring_regex(inside.dictionary, LETTERS)
    rest = inside.dictionary.filter(pc.invert(plain))
    whole = pc.binary_join_element_wise("", inside.dictionary.filter(plain), " ")
    plain = plain.to_numpy(zero_copy_only=False)
    words = find(" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), rest), " ")[0].as_py()) if len(rest) else []
    to = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    upto = np.searchsorted(to, np.cumsum(pc.utf8_length(rest).to_numpy() + 1), side="right")
    ends = [find(p) for p in outside.dictionary.to_numpy(zero_copy_only=False).tolist()]
    count = np.ones(len(plain) + len(ends), np.int64)
    count[: len(plain)][~plain] = np.diff(upto, prepend=0)
    count[len(plain) :] = np.fromiter(map(len, ends), np.int64, len(ends))
    # words in the order of their pieces, so that frequent ones have small numbers
    words.extend(chain.from_iterable(ends))
    at = np.ones(len(whole) + len(words), bool)
    at[(np.cumsum(count) - count)[: len(plain)][plain]] = False
    by = np.where(at, len(whole) + np.cumsum(at), np.cumsum(~at)) - 1
    of = np.empty(len(pieces), np.int64)
    of[inner] = inside.indices.to_numpy()
    of[first], of[last] = np.split(outside.indices.to_numpy() + len(plain), [len(first)])
    return pa.concat_arrays([whole, pa.array(words, texts.type)]).take(pa.array(by)).dictionary_encode(), of, count, n, order


def _placed(codes: np.ndarray, of: np.ndarray, count: np.ndarray, n: np.ndarray, order: np.ndarray) -> list[bytes]:
    """Packed word numbers of each text."""
    each = count[of]
    to = np.cumsum(each)
    at = np.repeat((np.cumsum(count) - count)[of] - (to - each), each) + np.arange(to[-1])
    out = packs(codes[at], to[np.cumsum(n) - 1])
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return [out[i] for i in back.tolist()]


def _numbered(it: Iterator[pa.RecordBatch], pattern: str, partitions: int) -> Iterator[tuple[list[int], pa.Array, pa.DictionaryArray, tuple]]:
    """([home, chunk, digest], keys, numbered words, what _placed() asks for) of each chunk.

    Homes run on from one task to the next, so the chunks of neighbouring tasks go to different partitions.
    """
    import regex
    import xxhash
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    find = regex.compile(WORDS + pattern[len(CLITICS) :] if pattern.startswith(CLITICS) else pattern).findall
    for k, (keys, texts) in enumerate(_chunks(it)):
        digest = xxhash.xxh3_64()
        for t in texts:
            digest.update(t.as_buffer())
            digest.update(b"\xff")
        words, *places = _searched(texts, find, pattern == CLITICS + OTHERS)
        yield [(task + 7919 * k) % partitions, task << 32 | k, digest.intdigest() >> 1], keys, words, places


NAME = "home int, chunk long, digest long"


def _named(name: list[int], n: int) -> list[pa.Array]:
    return [pa.array([v] * n, kind) for v, kind in zip(name, (pa.int32(), pa.int64(), pa.int64()))]


def _words(pattern: str, buckets: int, partitions: int):
    """The mapInArrow function of the first scan: a row for each chunk and bucket with its distinct words and their numbers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for name, _, number, _ in _numbered(it, pattern, partitions):
            words = number.dictionary.cast(pa.large_binary())
            if not len(words):
                continue
            home = (np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            words = words.take(pa.array(order))
            ends = np.append(np.flatnonzero(np.diff(home[order])) + 1, len(order))
            rows = []
            for i, j, ws in zip([0, *ends[:-1].tolist()], ends.tolist(), _joined(words, ends)):
                rows.append((int(home[order[i]]), _blob(pack(np.diff(order[i:j], prepend=0)), pack(pc.binary_length(words.slice(i, j - i)).to_numpy()), ws.as_py())))
            yield pa.RecordBatch.from_arrays([*_named(name, len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["home", "chunk", "digest", "bucket", "data"])

    return run


def _positions(pattern: str, partitions: int):
    """The mapInArrow function of the second scan: a row for each document with the word number at each position."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, keys, number, places in _numbered(it, pattern, partitions):
            data = _placed(number.indices.to_numpy(), *places)
            yield pa.RecordBatch.from_arrays([*_named(name, len(keys)), pa.array([1] * len(keys), pa.int32()), keys, pa.array(data, pa.binary())], ["home", "chunk", "digest", "kind", "id", "data"])

    return run


def _blob(*parts: bytes) -> bytes:
    """Parts in one compressed value."""
    raw = bytes([len(parts)]) + b"".join(len(p).to_bytes(4, "big") for p in parts) + b"".join(parts)
    return len(raw).to_bytes(4, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def _parts(packed: bytes) -> list[bytes]:
    blob = pa.decompress(packed[4:], int.from_bytes(packed[:4], "big"), codec="zstd", asbytes=True)
    n, at, out = blob[0], 1 + 4 * blob[0], []
    for k in range(n):
        size = int.from_bytes(blob[1 + 4 * k : 5 + 4 * k], "big")
        out.append(blob[at : at + size])
        at += size
    return out


def _encoded(held):
    """The mapInArrow function of step 2. Rows come sorted by bucket, so the words known so far are those of one bucket."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger: Merger = held.value
        known: dict[bytes, list[int]] = {}
        now = -1
        for b in it:
            rows = []
            new: dict[bytes, None] = {}
            for bucket, data in zip(b.column("bucket").to_pylist(), b.column("data").to_pylist()):
                numbers, sizes, words = _parts(data)
                ends = np.cumsum(unpack(sizes)).tolist()
                ws = [words[i:j] for i, j in zip([0, *ends], ends)]
                if bucket != now:
                    known, now = {}, bucket  # words of another bucket are other words
                rows.append((numbers, ws, known))
                new.update((w, None) for w in ws if w not in known)
                known.update((w, ()) for w in ws if w not in known)
            ids_of = merger.encode(list(new))
            out = []
            for numbers, ws, table in rows:
                for w in ws:
                    if not table[w]:
                        table[w] = ids_of[w]
                each = [table[w] for w in ws]
                out.append(_blob(numbers, pack(np.array([len(x) for x in each])), pack(np.array([i for x in each for i in x]))))
            yield pa.RecordBatch.from_arrays([b.column("home"), b.column("chunk"), b.column("digest"), pa.array([0] * len(out), pa.int32()), pa.array(out, pa.binary())], ["home", "chunk", "digest", "kind", "data"])

    return run


class _Chunk:
    """The words of a chunk as they are said, each id with a comma behind it, decoded and counted."""

    def __init__(self, digest: int) -> None:
        self.digest, self.parts, self.count = digest, [], None

    def add(self, data: bytes) -> None:
        numbers, counts, ids = map(unpack, _parts(data))
        self.parts.append((np.cumsum(numbers), counts, ids))

    def close(self, said: pa.Array, raw: pa.Array) -> None:
        if self.count is None:
            numbers, counts, ids = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*self.parts) if self.parts else [()] * 3))
            order = np.argsort(numbers)
            if (numbers[order] != np.arange(len(numbers))).any():
                raise ValueError("a word of the chunk has no ids")
            flat, ends, by = pa.array(ids), np.cumsum(counts), pa.array(order)
            self.count = counts[order]
            self.said, self.raw = (_joined(x.take(flat), ends).take(by) for x in (said, raw))
            self.ids = pa.LargeListArray.from_arrays(np.concatenate(([0], ends)), flat).take(by)


def _assembled(tokens, kind: pa.DataType, full: bool):
    """The mapInArrow function of step 3: rows come by chunk, the ids of its words before the positions of its documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        table = tokens.value
        said = pa.array([b"%d," % i for i in range(max(table) + 1)], pa.large_binary())
        raw = pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.large_binary())
        now, c = None, _Chunk(0)
        for b in it:
            what, data = b.column("kind").to_numpy(), b.column("data")
            chunks, digests = b.column("chunk").to_numpy(), b.column("digest").to_numpy()
            cuts = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(what) != 0) | (np.diff(digests) != 0)) + 1
            rows = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "ids": [], "decoded": []}
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(what)]):
                if i == j:
                    continue
                if chunks[i] != now:
                    now, c = chunks[i], _Chunk(digests[i])
                if digests[i] != c.digest:
                    raise ValueError("the documents of a chunk changed between the scans")
                values = data.slice(i, j - i).to_pylist()
                if what[i] == 0:
                    for v in values:
                        c.add(v)
                    continue
                c.close(said, raw)
                packed = b"".join(values)
                seq = unpack(packed)
                if len(seq) and seq.max() >= len(c.count):
                    raise ValueError("the documents of a chunk changed between the scans")
                # a number ends where the high bit is not set
                upto = np.concatenate(([0], np.cumsum(np.frombuffer(packed, np.uint8) < 128)))[np.cumsum([len(v) for v in values])]
                n = np.concatenate(([0], np.cumsum(c.count[seq])))[upto]
                by = pa.array(seq)
                for s in _joined(c.said.take(by), upto):
                    rows["ids_sha256"].append(hashlib.sha256(memoryview(s.as_buffer())[:-1]).hexdigest())
                texts = _joined(c.raw.take(by), upto)
                rows["decoded_sha256"] += [hashlib.sha256(s.as_buffer()).hexdigest() for s in texts]
                rows["n_tokens"] += np.diff(n, prepend=0).tolist()
                if full:
                    ids = c.ids.take(by).flatten().to_pylist()
                    rows["ids"] += [ids[x:y] for x, y in zip([0, *n.tolist()], n.tolist())]
                    rows["decoded"] += [s.as_py().decode("utf-8", "replace") for s in texts]
            cols = [b.column("id").filter(pa.array(what == 1)).cast(kind), pa.array(rows["n_tokens"], pa.int64()), pa.array(rows["ids_sha256"], pa.string()), pa.array(rows["decoded_sha256"], pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                cols += [pa.array(rows["ids"], pa.list_(pa.int32())), pa.array(rows["decoded"], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", column: str = "text", full: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), with ``full`` also the ids and the decoded text, for every row of docs."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark: SparkSession = docs.sparkSession
    batches(spark)
    ranks = read_ranks(ranks_path)
    held = spark.sparkContext.broadcast(Merger(ranks))
    tokens = spark.sparkContext.broadcast({i: b for b, i in ranks.items()})
    kind_sql, kind = docs.schema[id_column].dataType.simpleString(), to_arrow_type(docs.schema[id_column].dataType)
    size = input_bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES) if size < 1 << 60 else 0)  # rows from no table have no size
    d = docs.select(F.col(id_column).alias("id"), text(column).alias("t"))
    words = d.mapInArrow(_words(pattern, n * BUCKETS_EACH, n), f"{NAME}, bucket int, data binary").repartition(n, "bucket").sortWithinPartitions("bucket")
    places = d.mapInArrow(_positions(pattern, n), f"{NAME}, kind int, id {kind_sql}, data binary")
    ids = words.mapInArrow(_encoded(held), f"{NAME}, kind int, data binary").withColumn("id", F.lit(None).cast(kind_sql))
    rows = places.unionByName(ids).repartitionById(n, F.col("home")).sortWithinPartitions("chunk", "kind")
    schema = f"id {kind_sql}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return rows.mapInArrow(_assembled(tokens, kind, full), schema)
