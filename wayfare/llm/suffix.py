"""Exact removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

A string of ``length`` bytes is removed where it also starts anywhere else. Suffixes are sorted by buckets, refined only
as far as that question needs:

* *q-gram buckets.* Identifiers of 25-grams are refined to 50- and 100-grams by pairing each position's identifier with
  that of the later offset; each refinement reuses the last. Of the 100-grams inside a string the least is its anchor
  (leftmost of equals), so equal strings have the same anchor at the same place in them: only anchors stand in buckets,
  about one position in 150. Neighbouring strings with one anchor make one row, a *run*. Buckets of one row are done.
* *Runs.* Equal runs of a bucket form a class, whose strings are all repeated. One run of each class stays.
* *Refinement.* Strings of a run are split into eight ranges by the anchor's place in them. A bucket is refined by the
  identifiers of the bytes left and right of the anchor that all strings of a range share; ranges alone in their new
  bucket are done, ranges that are equal as a whole are repeated. Only ranges of which some part differs are refined to
  single strings.

*Shared passages.* With ``words`` each document also gets the number of its words that stand in a passage of that many words
which another document has too. It is the same search on identifiers of words: word by word refined to 16-grams, anchors
in buckets, equal runs, then single passages of the buckets whose runs differ. Nothing more is removed by it.

Every step is a partial aggregation on identifiers; no group of equal strings is gathered. Identifiers are 64 bits of
nonlinear mixing over content; equal identifiers count as equal content.

Defined cases: a null text is empty; texts under ``length`` bytes are kept; repeated rows (same id, same text) are
separate places of their strings, so both lose them; repeated ids with other texts are told apart by the text's hash. For
shared passages repeated rows are one document. Words are what stands between space, tab to carriage return.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import batches, materialize, released, text

LENGTH, GRAM, RANGES = 400, 100, 8
#: Words of a passage that counts as shared.
WORDS = 50
#: Bytes that are bucketed together, and bits for a place among them.
SEGMENT, PLACE = 1 << 19, np.uint64(20)

_B = 0x9E3779B97F4A7C15 | 1
_ONE = np.ones(1, np.uint64)
_POWER = np.cumprod(np.concatenate((_ONE, np.full(SEGMENT + LENGTH, _B, np.uint64))), dtype=np.uint64)
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BACK = np.cumprod(np.concatenate((_ONE, np.full(SEGMENT + LENGTH, pow(_B, -1, 1 << 64), np.uint64))), dtype=np.uint64)


def _mix(v: np.ndarray) -> np.ndarray:
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(29)
    return v


def _refined(ids: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of twice the depth: of the bucket at each position and the bucket at the later offset."""
    return _mix(ids[:-offset] * np.uint64(0xA0761D6478BD642F) + (ids[offset:] ^ (ids[offset:] >> np.uint64(31))) * np.uint64(0xE7037ED1A0B428DB))


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Identifiers of the GRAM-byte strings at each position of at most SEGMENT + LENGTH bytes."""
    n, q = len(data), GRAM // 4
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWER[:n], dtype=np.uint64)))
    ids = _mix((sums[q:] - sums[:-q]) * _BACK[: n - q + 1])
    return _refined(_refined(ids, q), 2 * q)


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(first start, number of starts, anchor, anchor identifier) of the runs of a buffer of documents that end at ``ends``."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return _runs(gram_ids(data), ends, length, GRAM)


def _runs(ids: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    keys = (ids >> PLACE << PLACE) | np.arange(len(ids), dtype=np.uint64)
    wide, have = length - gram + 1, 1
    low = keys
    while have < wide:
        step = min(have, wide - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    anchor = (low & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)
    starts = np.arange(len(anchor))
    doc = np.searchsorted(ends, starts, side="right")
    good = starts + length <= ends[doc]
    x = np.flatnonzero(good)
    if not len(x):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    a, d = anchor[x], doc[x]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1]) | (x[1:] != x[:-1] + 1)))
    at = np.flatnonzero(new)
    count = np.diff(np.concatenate((at, [len(x)])))
    return x[at], count, a[at], ids[a[at]]


def _segments(b: pa.RecordBatch, length: int) -> Iterator[tuple[list[int], list[int], list[int], bytes]]:
    """(rows, offsets in their documents, ends in the buffer, buffer): whole documents, or parts that overlap by length - 1."""
    rows: list[int] = []
    offsets: list[int] = []
    ends: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(b.column(2)):
        data = t.as_buffer().to_pybytes()
        for at in range(0, max(len(data) - length + 1, 0), SEGMENT):
            part = data[at : at + SEGMENT + length - 1]
            if size and size + len(part) > SEGMENT + length - 1:
                yield rows, offsets, ends, b"".join(parts)
                rows, offsets, ends, parts, size = [], [], [], [], 0
            rows.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            ends.append(size)
    if size:
        yield rows, offsets, ends, b"".join(parts)


def _sampled(length: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in it:
            for rows, offsets, ends, buffer in _segments(b, length):
                ends = np.array(ends)
                x, n, a, h = runs(np.frombuffer(buffer, np.uint8), ends, length)
                doc = np.searchsorted(ends, x, side="right")
                begin = np.concatenate(([0], ends[:-1]))
                of = xxhash.xxh3_64_intdigest
                c = [of(buffer[i : i + k + length - 1], o) for i, k, o in zip(x.tolist(), n.tolist(), (a - x).tolist())]
                take = pa.array(np.array(rows)[doc])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(h.view(np.int64)), pa.array(np.array(c, np.uint64).view(np.int64)), pa.array((x - begin[doc] + np.array(offsets)[doc]).astype(np.int64)), pa.array(n.astype(np.int32)), pa.array((a - x).astype(np.int32))],
                    ["id", "th", "h", "c", "x", "n", "o"],
                )

    return run


def word_ids(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and identifiers of the words of a buffer."""
    import xxhash

    edges = np.flatnonzero(np.diff(~_BLANK[data], prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    ids = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        at, part = starts[i], data[starts[i] : ends[j - 1]]
        if len(part) <= SEGMENT:
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWER[: len(part)], dtype=np.uint64)))
            ids[i:j] = _mix((sums[ends[i:j] - at] - sums[starts[i:j] - at]) * _BACK[starts[i:j] - at])
        i = j
    for k in np.flatnonzero(ends - starts > 256):
        ids[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return starts, ids


def _deep(ids: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of the strings of ``depth`` units at each position, from those of single units; at least depth units."""
    have = 1
    while have < depth:
        step = min(have, depth - have)
        ids = _refined(ids, step)
        have += step
    return ids


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the words of all texts, one after the other, and where each text ends among them."""
    parts = [t.as_buffer().to_pybytes() for t in texts]
    starts, ids = word_ids(np.frombuffer(b" ".join(parts), np.uint8))
    return ids, np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))


def _sampled_words(words: int, gram: int):
    """Runs of passages, as _sampled has them of strings; places are counted in words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = xxhash.xxh3_64_intdigest
        for b in it:
            ids, ends = _words(b.column(2))
            begin = np.concatenate(([0], ends[:-1]))
            raw = ids.tobytes()
            for at in range(0, max(len(ids) - words + 1, 0), SEGMENT):
                x, n, a, h = _runs(_deep(ids[at : at + SEGMENT + words - 1], gram), ends - at, words, gram)
                o, x = a - x, x + at
                doc = np.searchsorted(ends, x, side="right")
                c = [of(raw[8 * i : 8 * (i + k + words - 1)], p) for i, k, p in zip(x.tolist(), n.tolist(), o.tolist())]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(h.view(np.int64)), pa.array(np.array(c, np.uint64).view(np.int64)), *(pa.array(v.astype(np.int32)) for v in (x - begin[doc], n, o))],
                    ["id", "th", "h", "c", "x", "n", "o"],
                )

    return run


def _passages(words: int):
    """A row for each single passage of the runs of a document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, ends = _words(b.column("t"))
            deep = np.empty(len(ids), np.uint64)
            for at in range(0, len(ids) - words + 1, SEGMENT):
                part = _deep(ids[at : at + SEGMENT + words - 1], words)
                deep[at : at + len(part)] = part
            runs_ = b.column("runs").flatten()
            c, k1, k2, x, n, o = (runs_.field(k).to_numpy(zero_copy_only=False) for k in range(6))
            x = x + np.repeat(np.concatenate(([0], ends[:-1])), b.column("runs").value_lengths().to_numpy(zero_copy_only=False))
            cuts = np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // SEGMENT)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(n)]):
                m = n[i:j]
                k = np.arange(m.sum()) - np.repeat(np.cumsum(m, dtype=np.int64) - m, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(c[i:j], m)), pa.array((np.repeat(o[i:j], m) - k).astype(np.int32)), pa.array(deep[np.repeat(x[i:j], m) + k].view(np.int64)), pa.array(np.repeat(k1[i:j], m)), pa.array(np.repeat(k2[i:j], m))],
                    ["c", "d", "string", "k1", "k2"],
                )

    return run


def _covered(marks: pa.ListArray, words: int) -> np.ndarray:
    """Number of words that the marked passages of each document cover."""
    at = marks.flatten()
    row = np.repeat(np.arange(len(marks)), np.nan_to_num(marks.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    lo, hi = ((row << 32) + at.field(k).to_numpy(zero_copy_only=False) for k in range(2))
    order = np.argsort(lo)
    lo, end = lo[order], np.maximum.accumulate(hi[order] + words)
    new = end - np.maximum(lo, np.concatenate(([0], end[:-1])))
    return np.bincount(row[order], weights=new, minlength=len(marks)).astype(np.int64)


def _ranges(n: int, o: int, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Ranges of a run: (number, first and last place of the anchor that all runs have for it, and of this run's strings).

    A string that starts k after the run's start has the anchor at o - k.
    """
    places = length - GRAM + 1
    width = -(-places // RANGES)
    for j in range(RANGES):
        lo, hi = j * width, min((j + 1) * width, places) - 1
        mine_lo, mine_hi = max(lo, o - n + 1), min(hi, o)
        if mine_lo <= mine_hi:
            yield j, lo, hi, mine_lo, mine_hi


def _refine(length: int):
    """Rows of ranges: their bucket by what all strings of the range share, and their identity as a whole."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = xxhash.xxh3_64_intdigest
        for b in it:
            rows: list[tuple] = []
            for k, (n, o, s) in enumerate(zip(b.column("n").to_pylist(), b.column("o").to_pylist(), b.column("s").to_pylist())):
                for j, lo, hi, mine_lo, mine_hi in _ranges(n, o, length):
                    rows.append((k, j, of(s[o - lo : o - hi + length], j), of(s[o - mine_hi : o - mine_lo + length], mine_lo << 12 | mine_hi), mine_lo, mine_hi))
            cols = list(zip(*rows)) or [()] * 6
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("h").take(take), b.column("c").take(take), b.column("m").take(take), pa.array(cols[1], pa.int32()), *(pa.array(np.array(v, np.uint64).view(np.int64)) for v in cols[2:4]), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.int32())],
                ["h", "c", "m", "j", "shared", "whole", "lo", "hi"],
            )

    return run


def _singles(length: int):
    """A row for each single string of a range."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        of = xxhash.xxh3_64_intdigest
        for b in it:
            rows = [
                (k, d, of(s[o - d : o - d + length], d))
                for k, (o, s, lo, hi) in enumerate(zip(*(b.column(c).to_pylist() for c in ("o", "s", "lo", "hi"))))
                for d in range(lo, hi + 1)
            ]
            cols = list(zip(*rows)) or [()] * 3
            take = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("h").take(take), b.column("c").take(take), b.column("m").take(take), pa.array(cols[1], pa.int32()), pa.array(np.array(cols[2], np.uint64).view(np.int64))], ["h", "c", "m", "d", "string"])

    return run


def _cut(length: int, spans: bool, words: int):
    """Removes the covered bytes of each document, and counts its words in shared passages."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for t, marks in zip(b.column("t"), b.column("marks").to_pylist()):
                data = t.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for m in sorted((m["lo"], m["hi"]) for m in marks or ()):
                    if merged and m[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], m[1] + length)
                    else:
                        merged.append([m[0], m[1] + length])
                at, kept = 0, []
                for lo, hi in merged:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                left = b"".join(kept)
                out["n_bytes"].append(len(data))
                out["n_removed"].append(len(data) - len(left))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept"].append(left if spans else None)
            cols = [b.column("id"), *(pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if spans:
                cols.append(pa.array(out["kept"], pa.binary()))
                names.append("kept")
            if words:
                cols.append(pa.array(_covered(b.column("shared"), words)))
                names.append("n_shared_words")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, th, lo, hi): starts lo to hi of repeated strings, for ``docs(id, th, t)``; the same starts may come twice."""
    kind = docs.schema["id"].dataType.simpleString()
    with released(docs.sparkSession) as keep:
        with released(docs.sparkSession) as early:
            s = early(docs.select("id", "th", "t").mapInArrow(_sampled(length), f"id {kind}, th long, h long, c long, x long, n int, o int"))
            # written, so that the join has a plain exchange on both sides and a hot bucket of it can be split
            buckets = keep(s.groupBy("h").agg(F.count("*").alias("rows"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("rows > 1").select("h", (F.col("c1") == F.col("c2")).alias("alike")))
            s = keep(s.join(buckets, "h"))
        whole = lambda d: d.select("id", "th", F.col("x").alias("lo"), (F.col("x") + F.col("n") - 1).alias("hi"))
        mixed = s.where("NOT alike")
        classes = keep(mixed.groupBy("h", "c").agg(F.count("*").alias("m"), F.min(F.struct("id", "th", "x", "n", "o")).alias("r")).select("h", "c", "m", "r.*"))
        alike = whole(s.where("alike")).union(whole(mixed.join(classes.where("m > 1").select("h", "c"), ["h", "c"], "left_semi")))
        # one run of each class, with its bytes
        wanted = keep(classes.groupBy("id", "th").agg(F.collect_list(F.struct("h", "c", "m", "x", "n", "o")).alias("runs")))
        r = docs.join(wanted.withColumnsRenamed({"id": "id2", "th": "th2"}), F.col("id").eqNullSafe(F.col("id2")) & F.col("th").eqNullSafe(F.col("th2")))
        r = r.select("id", "th", "t", F.explode("runs").alias("r")).select("id", "th", "r.*", F.expr(f"substring(t, r.x + 1, r.n + {length - 1})").alias("s")).dropDuplicates(["h", "c"])
        r = keep(r)
        t = keep(r.select("h", "c", "m", "n", "o", "s").mapInArrow(_refine(length), "h long, c long, m long, j int, shared long, whole long, lo int, hi int"))
        wholes = t.groupBy("h", "j", "shared", "whole").agg(F.sum("m").alias("w"), F.min("c").alias("c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
        groups = wholes.groupBy("h", "j", "shared").agg(F.count("*").alias("kinds"), F.min("w").alias("least"))
        # equal as a whole: repeated, and only classes of one run still ask
        one = t.where("m = 1")
        equal = one.join(wholes.where("w > 1").select("h", "j", "shared", "whole"), ["h", "j", "shared", "whole"], "left_semi").select("h", "c", "lo", "hi")
        # of the others, the buckets with several kinds of which some range is alone
        open_ = wholes.join(groups.where("kinds > 1 AND least = 1").select("h", "j", "shared"), ["h", "j", "shared"], "left_semi").select("h", "c", F.col("w").alias("m"), "lo", "hi")
        singles = keep(open_.join(r.select("h", "c", "o", "s"), ["h", "c"]).select("h", "c", "m", "o", "s", "lo", "hi").mapInArrow(_singles(length), "h long, c long, m long, d int, string long"))
        twice = singles.groupBy("h", "d", "string").agg(F.sum("m").alias("w")).where("w > 1").select("h", "d", "string")
        found = singles.where("m = 1").join(twice, ["h", "d", "string"], "left_semi").select("h", "c", F.col("d").alias("lo"), F.col("d").alias("hi"))
        at = r.where("m = 1").select("id", "th", "h", "c", "x", "o")
        parts = equal.union(found).join(at, ["h", "c"]).select("id", "th", (F.col("x") + F.col("o") - F.col("hi")).alias("lo"), (F.col("x") + F.col("o") - F.col("lo")).alias("hi"))
        return materialize(alike.union(parts))


def shared(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(id, th, lo, hi): first words lo to hi of passages that another of ``docs(id, th, t)`` has too; the same may come twice."""
    kind = docs.schema["id"].dataType.simpleString()
    key = F.xxhash64("id", "th")
    gram = 1 << (words // 3).bit_length() - 1
    with released(docs.sparkSession) as keep:
        with released(docs.sparkSession) as early:
            s = early(docs.select("id", "th", "t").mapInArrow(_sampled_words(words, gram), f"id {kind}, th long, h long, c long, x int, n int, o int"))
            buckets = s.groupBy("h").agg(F.min(key).alias("k1"), F.max(key).alias("k2"), F.min("c").alias("c1"), F.max("c").alias("c2"))
            buckets = keep(buckets.where("k1 != k2").select("h", (F.col("c1") == F.col("c2")).alias("alike")))
            s = keep(s.join(buckets, "h"))
        whole = lambda d: d.select("id", "th", F.col("x").alias("lo"), (F.col("x") + F.col("n") - 1).alias("hi"))
        mixed = s.where("NOT alike")
        classes = keep(mixed.groupBy("c").agg(F.min(key).alias("k1"), F.max(key).alias("k2"), F.min(F.struct("id", "th", "x", "n", "o")).alias("r")).select("c", "k1", "k2", "r.*"))
        alike = whole(s.where("alike")).union(whole(mixed.join(classes.where("k1 != k2").select("c"), "c", "left_semi")))
        # one run of each class, passage by passage; only classes of one document still ask
        wanted = keep(classes.groupBy("id", "th").agg(F.collect_list(F.struct("c", "k1", "k2", "x", "n", "o")).alias("runs")))
        r = docs.join(wanted.withColumnsRenamed({"id": "id2", "th": "th2"}), F.col("id").eqNullSafe(F.col("id2")) & F.col("th").eqNullSafe(F.col("th2")))
        with released(docs.sparkSession) as early:
            singles = early(r.select("t", "runs").mapInArrow(_passages(words), "c long, d int, string long, k1 long, k2 long"))
            twice = singles.groupBy("string").agg(F.min("k1").alias("k1"), F.max("k2").alias("k2")).where("k1 != k2").select("string")
            found = keep(singles.where("k1 = k2").join(twice, "string", "left_semi").select("c", "d"))
        at = F.col("x") + F.col("o") - F.col("d")
        return materialize(alike.union(mixed.join(found, "c").select("id", "th", at.alias("lo"), at.alias("hi"))))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", column: str = "text", length: int = LENGTH, full: bool = False, words: int = 0) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256), with ``full`` also the kept bytes, for every row of docs.

    With ``words`` also n_shared_words: words in passages of that many words that another document has too.
    """
    if not 2 * GRAM <= length <= 4 * GRAM * 8:
        raise ValueError("length must be at least two grams")
    if words and not 3 <= words <= SEGMENT:
        raise ValueError("a passage has three words at least")
    batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    d = docs.select(F.col(id_column).alias("id"), F.xxhash64(text(column)).alias("th"), F.encode(text(column), "UTF-8").alias("t"))
    marks, lists = repeated(d, length), {"marks": F.struct("lo", "hi")}
    if words:
        marks = marks.withColumn("s", F.lit(False)).union(shared(d, words).withColumn("s", F.lit(True)))
        lists = {"marks": F.when(~F.col("s"), F.struct("lo", "hi")), "shared": F.when(F.col("s"), F.struct("lo", "hi"))}
    marks = materialize(marks.groupBy("id", "th").agg(*(F.collect_set(v).alias(k) for k, v in lists.items()))).withColumnsRenamed({"id": "id2", "th": "th2"})
    joined = d.join(marks, d.id.eqNullSafe(marks.id2) & d.th.eqNullSafe(marks.th2), "left").select("id", "t", *lists)
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full + ", n_shared_words long" * bool(words)
    return joined.mapInArrow(_cut(length, full, words), schema)
