"""SimHash near-duplicates by a binary-trie self-join.

Texts become 64-bit fingerprints; equal fingerprints collapse to one trie leaf, so copies cost one row. Two fingerprints
within ``k`` bits agree wholly on one of ``k + 1`` bands of bits; for each band the fingerprints that share it form a
subtrie whose other bits have the whole error budget. Inside a subtrie node pairs are traversed together, level by level,
adding up the bits in which they differ and dropping a pair once it is over the budget. Subtries above ``split`` leaves
are dealt out once more, by the node pairs of their next bits within the budget, so that no task holds an unbounded group.

A task emits only a spanning forest of the links it finds (each link joins two groups not yet joined there), never all
pairs of a group. Components of those forests are the components of all links.

Defined cases: null or blank texts have the fingerprint zero and link like any other; fewer words than a shingle give one
shingle of all words; repeated rows and repeated ids are judged row by row; extra columns are ignored by :func:`groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import batches, materialize, text
from wayfare.llm.components import components

BITS, BUDGET, WORDS, SEED = 64, 3, 3, 42
#: Leaves of a subtrie beyond which it is dealt out by node pairs of its next SPLIT_BITS bits.
SPLIT, SPLIT_BITS = 20_000, 6
#: Leaves of a subtrie on average, as long as its band has bits for that.
EACH = 128


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: majority of the XXH64 bits of its word shingles."""
    import xxhash

    w = data.lower().split()  # on bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(w) <= words:
        return h64(b" ".join(w), seed)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(w) - words + 1
    votes = np.zeros(BITS, np.int64)
    s, e = starts[:n].tolist(), ends[words - 1 :].tolist()
    for at in range(0, n, 4096):
        h = np.array([h64(joined[i:j], seed) for i, j in zip(s[at : at + 4096], e[at : at + 4096])], ">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", column: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp): one row per row of docs, fp as a signed long."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            f = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(f, np.uint64).view(np.int64))], ["id", "fp"])

    batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), text(column).alias("t")).mapInArrow(run, f"id {kind}, fp long")


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n, dtype=np.int64)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def flat(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return nxt
            self.up = nxt


def trie_links(fps: np.ndarray, budget: int = BUDGET, sides: np.ndarray | None = None, block: int = 1 << 18) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sorted distinct fingerprints within ``budget`` bits.

    The trie is the sorted array: a node is a range of it that shares a prefix. A frontier of node pairs with their
    differing bits is carried down; pairs over the budget are dropped, and so are pairs whose leaves are all in one group
    already. With ``sides`` (0 or 1 for each fingerprint) only pairs across the two sides are looked for.
    """
    n = len(fps)
    if n < 2:
        return []
    u = np.sort(fps.astype(np.uint64))
    order = np.argsort(fps.astype(np.uint64), kind="stable")
    forest, links = _Forest(n), []
    # frontier: [lo1, hi1) x [lo2, hi2), bits so far, level; depth first over blocks of pairs to bound memory
    stack = [(np.array([[0, n, 0, n]], np.int64), np.zeros(1, np.int64), 0)]
    while stack:
        pairs, bits, level = stack.pop()
        if len(pairs) > block:
            for at in range(0, len(pairs), block):
                stack.append((pairs[at : at + block], bits[at : at + block], level))
            continue
        flat = forest.flat()
        # a range lies in one group if its least and greatest group agree
        small = (pairs[:, 1] - pairs[:, 0] + pairs[:, 3] - pairs[:, 2]) <= 2
        same = small & (flat[pairs[:, 0]] == flat[pairs[:, 2]]) & ((pairs[:, 0] != pairs[:, 2]) | (pairs[:, 1] - pairs[:, 0] == 1))
        one = small & (pairs[:, 0] == pairs[:, 2])
        keep = ~(same | one)
        big = np.flatnonzero(keep & ~small)
        if len(big):
            change = np.concatenate(([0], np.cumsum(flat[1:] != flat[:-1])))
            p = pairs[big]
            uniform = (change[p[:, 0]] == change[p[:, 1] - 1]) & (change[p[:, 2]] == change[p[:, 3] - 1]) & (flat[p[:, 0]] == flat[p[:, 2]])
            keep[big[uniform]] = False
        pairs, bits, small = pairs[keep], bits[keep], small[keep]
        # leaf pairs: compare what is left at once
        if small.any():
            p = pairs[small]
            d = np.bitwise_count(u[p[:, 0]] ^ u[p[:, 2]])
            for i, j in p[d <= budget][:, [0, 2]].tolist():
                if forest.join(i, j):
                    links.append((int(order[i]), int(order[j])))
            pairs, bits = pairs[~small], bits[~small]
        if not len(pairs) or level >= BITS:
            continue
        mask = np.uint64(1) << np.uint64(BITS - 1 - level)
        # where each range turns from bit 0 to bit 1: the range is sorted and shares the bits above
        ones = np.concatenate(([0], np.cumsum((u & mask) != 0)))
        m1 = pairs[:, 1] - (ones[pairs[:, 1]] - ones[pairs[:, 0]])
        m2 = pairs[:, 3] - (ones[pairs[:, 3]] - ones[pairs[:, 2]])
        lo1, hi1, lo2, hi2 = pairs.T
        same_node = (lo1 == lo2) & (hi1 == hi2)
        kids = [
            (np.stack([lo1, m1, lo2, m2], 1), bits),
            (np.stack([m1, hi1, m2, hi2], 1), bits),
            (np.stack([lo1, m1, m2, hi2], 1), bits + 1),
            (np.stack([m1, hi1, lo2, m2], 1)[~same_node], (bits + 1)[~same_node]),
        ]
        p = np.concatenate([k[0] for k in kids])
        b = np.concatenate([k[1] for k in kids])
        ok = (b <= budget) & (p[:, 0] < p[:, 1]) & (p[:, 2] < p[:, 3])
        if ok.any():
            stack.append((p[ok], b[ok], level + 1))
    return links


def links(fps: DataFrame, n: int, budget: int = BUDGET, split: int = SPLIT, split_bits: int = SPLIT_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fps(fp)`` within ``budget`` bits, a spanning forest for each subtrie.

    Band ``i`` rotates its bits to the front, so that the shared band is the root of the subtrie and the traversal starts
    below it. Each of ``budget + 1`` copies of a fingerprint goes to one subtrie, or, where that has more than ``split``
    leaves, to the node pairs of its next ``split_bits`` bits that are within the budget. Of ``n`` fingerprints, the first
    log2(n / EACH) bits of a band, all of them at most, name the subtrie; the traversal takes it from there.
    """
    width = BITS // (budget + 1)
    depth = min(width, max(1, (max(n, 1) // EACH).bit_length()))
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.expr(f"(fp << {i * width}) | shiftrightunsigned(fp, {BITS - i * width})" if i else "fp").alias("rot")) for i in range(budget + 1)])).alias("x")
    rows = fps.select(bands).select("x.band", "x.rot").withColumn("root", F.expr(f"shiftrightunsigned(rot, {BITS - depth})"))
    sizes = rows.groupBy("band", "root").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["band", "root"])
    node = F.expr(f"shiftrightunsigned(rot, {BITS - depth - split_bits}) & {(1 << split_bits) - 1}").cast("int")
    near = [[j for j in range(1 << split_bits) if (i ^ j).bit_count() <= budget] for i in range(1 << split_bits)]
    cells = F.element_at(F.array(*[F.array(*[F.lit(f"{min(i, j)}-{max(i, j)}") for j in js]) for i, js in enumerate(near)]), node + 1)
    rows = rows.withColumn("cell", F.explode(F.when(F.col("n") > split, cells).otherwise(F.array(F.lit("")))))

    def run(_key: tuple, t: pa.Table) -> pa.Table:
        rot = t.column("rot").to_numpy().astype(np.int64).view(np.uint64)
        band = t.column("band")[0].as_py()
        found = trie_links(rot, budget)
        s = np.uint64(band * width)
        fp = (rot >> s) | (rot << np.uint64(BITS - band * width)) if band else rot
        fp = fp.view(np.int64)
        a, b = (np.array([x[i] for x in found], np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(fp[a] if len(a) else a), "b": pa.array(fp[b] if len(b) else b)})

    return rows.select("band", "root", "cell", "rot").groupBy("band", "root", "cell").applyInArrow(run, "a long, b long")


def groups(docs: DataFrame, id_column: str = "doc_id", column: str = "text", budget: int = BUDGET, words: int = WORDS) -> DataFrame:
    """(id, fp, component): each row with its class, the smallest id reachable over links, itself included."""
    rows = materialize(fingerprints(docs, id_column, column, words))
    leaves = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")))
    forest = components(links(leaves.select("fp"), leaves.count(), budget))
    rooted = leaves.join(forest, leaves.fp == forest.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    classes = rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component")
    # classes has one row per fingerprint; a fingerprint of very many rows is split by the adaptive skew join
    return rows.join(classes, F.col("fp") == F.col("_fp")).select("id", "fp", "component")
