"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are numbered in the order of a hash and cut into blocks. Block j (from 1) of a source of weight w is
released at slot floor((j - 1) / w) and due by ceil(j / w); each slot goes to the released block of the earliest deadline.
With weights that are whole parts of a period and sum to 1, every deadline is met, and after any number of slots a source
is less than one block from its share.

The schedule repeats with the period, so one period is worked out and the slot of any block follows by division: nothing
is sequential in the data. A source shorter than its share is repeated in further epochs, and its blocks run on from one
epoch into the next, so all of them are full and shares hold in rows as they do in slots. None is cut: the mix ends when
every source has been through its documents once. Only the last block of a source that comes exactly once may be short.

Rows alike in every column are one key with a count until they are numbered, so copies of a row are combined before the
shuffle and dealt out again after it; no window holds a whole source, or rows as such.

Defined cases: a null source is a source of its own; repeated rows are documents of their own; an empty table gives an
empty mix; columns may have any names, and no input column is changed. Weights are rounded to parts of the period unless
they are fractions of a smaller one; the period grows with the number of sources, and every source that has documents gets
one part at least.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import free_name, materialize, quoted

#: Least parts of a period, and parts for each source where that is more.
PERIOD, PARTS_EACH = 10_000, 4
BLOCK_ROWS, FLATTEN = 32, 0.7
#: Expected keys of a numbering bucket, and the least buckets of a source as a power of two.
BUCKET_ROWS, BUCKET_BITS = 20_000, 8
#: The plan of a period has a row for each part; it is broadcast up to so many rows, and joined like any table beyond.
BROADCAST_ROWS = 50_000


def parts(weights: dict, period: int = PERIOD) -> tuple[dict, int]:
    """(parts of each source, period): exact for fractions of a period up to ``period``, else by largest remainders."""
    exact = {s: Fraction(w).limit_denominator(10**9) for s, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be positive")
    total = sum(exact.values())
    exact = {s: w / total for s, w in exact.items()}
    period = max(period, PARTS_EACH * len(exact))
    least = 1
    for w in exact.values():
        least = math.lcm(least, w.denominator)
        if least > period:
            break
    if least <= period:
        return {s: int(w * least) for s, w in exact.items()}, least
    free = period - len(exact)
    out = {s: 1 + int(w * free) for s, w in exact.items()}
    rest = sorted(exact, key=lambda s: (-(exact[s] * free % 1), str(s)))
    for s in rest[: period - sum(out.values())]:
        out[s] += 1
    return out, period


def schedule(share: dict, period: int) -> dict[object, list[int]]:
    """For each source the slots of its blocks in one period: earliest deadline first among the released."""
    names = sorted(share, key=lambda s: (s is not None, str(s)))
    slots: dict[object, list[int]] = {s: [] for s in names}
    waiting = [(0, i, 1) for i in range(len(names))]
    ready: list[tuple[int, int, int]] = []
    heapq.heapify(waiting)
    for t in range(period if names else 0):
        while waiting and waiting[0][0] <= t:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * period // share[names[i]]), i, j))
        due, i, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline is missed")
        slots[names[i]].append(t)
        a = share[names[i]]
        if j < a:
            heapq.heappush(waiting, (j * period // a, i, j + 1))
    return slots


def flattened(counts: dict, power: float = FLATTEN) -> dict:
    """Default targets: shares of rows raised to a power, which lifts small sources."""
    return {s: Fraction(round(n**power * 1000), 1) for s, n in counts.items() if n}


def _bounded(d: DataFrame, rows: int) -> DataFrame:
    """d, to be broadcast only if its known number of rows is small."""
    return F.broadcast(d) if rows <= BROADCAST_ROWS else d


def _numbered(rows: DataFrame, total: int) -> DataFrame:
    """(k, h, g, start): for each key the rows of its source before it, in the order of (h, g).

    Counted by bucket of hashes first, so that windows hold the keys of a bucket, and the counts of a source's buckets.
    """
    bits = max(BUCKET_BITS, math.ceil(math.log2(max(1, total / BUCKET_ROWS))))
    keys = materialize(rows.groupBy("k", "h", "g").agg(F.count("*").alias("c"))).withColumn("b", F.shiftrightunsigned("h", 64 - bits))
    run = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = keys.groupBy("k", "b").agg(F.sum("c").alias("n")).select("k", "b", F.coalesce(F.sum("n").over(run(["k"], ["b"])), zero).alias("before"))
    keys = keys.withColumn("inside", F.coalesce(F.sum("c").over(run(["k", "b"], ["h", "g"])), zero))
    return keys.join(before, ["k", "b"]).select("k", "h", "g", (F.col("before") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", id_column: str = "doc_id", column: str = "text", block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """docs and, as the last column, ``_mix``: epoch, block, slot and position in the mix. A document comes once for each epoch.

    block counts the blocks of a source through all epochs. Where docs has a column of that name, underscores are put before it.
    """
    spark = docs.sparkSession
    counts = {r[0]: r[1] for r in docs.groupBy(quoted(source).alias("s")).count().collect()}
    if weights is None:
        weights = flattened(counts)
    if missing := [s for s in counts if s not in weights]:
        raise ValueError(f"no weight for sources {missing[:5]}")
    share, period = parts({s: w for s, w in weights.items() if s in counts}, period)
    slots = schedule(share, period)
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    end = max(((b - 1) // share[s] * period + slots[s][(b - 1) % share[s]] + 1 for s, b in blocks.items()), default=0)
    number = {s: k for k, s in enumerate(slots)}
    plan = []
    for s, n in counts.items():
        b = end // period * share[s] + sum(x < end % period for x in slots[s])  # its blocks among the first ``end`` slots
        plan.append((s, number[s], share[s], n, n if b == blocks[s] else b * block_rows))
    kind = docs.select(quoted(source)).schema[0].dataType.simpleString()
    plan = _bounded(spark.createDataFrame(plan, f"s {kind}, k long, a long, n long, r long"), len(counts))
    table = _bounded(spark.createDataFrame([(number[s], r, x) for s, xs in slots.items() for r, x in enumerate(xs)], "k long, jr long, at long"), period)

    # columns go by number inside, so that no name of docs meets one of ours
    names, inner = docs.columns, [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[quoted(c).alias(i) for c, i in zip(names, inner)], quoted(source).alias("s1"), F.xxhash64(quoted(id_column), quoted(column)).alias("h"), F.xxhash64(F.lit(1), *map(quoted, names)).alias("g"))
    rows = rows.join(plan.select(F.col("s").alias("s2"), "k"), F.col("s1").eqNullSafe(F.col("s2"))).select(*inner, "k", "h", "g")
    starts = _numbered(rows, sum(counts.values()))
    d = rows.groupBy("k", "h", "g").agg(F.count("*").alias("c"), *[F.first(i).alias(i) for i in inner])
    d = d.join(starts, ["k", "h", "g"]).join(plan.select("k", "a", "n", "r"), "k")
    each: Column = F.explode(F.expr("sequence(start, start + c - 1)"))
    d = d.select(*inner, "k", "a", "n", "r", each.alias("i"))
    d = d.select("*", F.explode(F.expr("sequence(0L, (r - 1 - i) div n)")).alias("epoch")).withColumn("x", F.expr("epoch * n + i")).withColumn("j", F.expr(f"x div {block_rows}"))
    d = d.withColumn("jr", F.expr("j % a")).join(table, ["k", "jr"])
    slot = F.expr(f"j div a * {period} + at")
    made = F.struct("epoch", F.col("j").alias("block"), slot.alias("slot"), (slot * block_rows + F.col("x") % block_rows).alias("position"))
    return d.select(*[F.col(i).alias(c) for c, i in zip(names, inner)], made.alias(free_name(docs, "_mix")))
