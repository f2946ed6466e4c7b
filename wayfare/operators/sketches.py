"""Bloom filters: sizes, membership, membership with an exact check, and an exact counting variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LN2 = 0.6931471805599453


def sizing(n: Column, p: Column) -> dict[str, Column]:
    """Bits, hash functions and the false-positive rate of a filter for n keys at rate p."""
    m = F.ceil(-n * F.log(p) / (LN2 * LN2))
    k = F.ceil(m / n * LN2)
    return {"bits": m.cast("long"), "hashes": k.cast("int"), "fpp": F.pow(1 - F.exp(-k * n / m), k)}


def bits_of(build: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(bucket, bitmap): the filter of build's keys as bitmaps of 32768 bits, made by one aggregation."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)])).alias("bit")
    return build.select(at).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def membership(build: DataFrame, probe: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """(key, maybe) of probe's distinct keys: whether all bits of a key are set; no false negatives."""
    filter_ = bits_of(build, key, bits, hashes)
    at = F.explode(F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)])).alias("bit")
    d = probe.select(key).distinct().select(key, at).withColumn("bucket", F.bitmap_bucket_number("bit")).withColumn("pos", F.bitmap_bit_position("bit"))
    byte = F.expr("conv(hex(substring(bitmap, CAST(pos DIV 8 AS INT) + 1, 1)), 16, 10)").cast("int")
    set_ = F.expr("shiftright(b, CAST(pos % 8 AS INT))").bitwiseAND(1) == 1
    d = d.join(filter_, "bucket", "left").withColumn("b", F.coalesce(byte, F.lit(0)))
    return d.groupBy(key).agg(F.min(set_).alias("maybe"))


def exact_membership(build: DataFrame, probe: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """membership() as SQL's IN answers it: a key that the filter lets through is looked up in build.

    Right at any number of keys; a filter too small for them only lets more keys through to the join. As in SQL, the answer is
    null for a null key, and where a key is not found but build holds a null; over an empty build it is false.
    """
    known = build.where(F.col(key).isNotNull()).select(F.col(key).alias("_known")).distinct()
    sizes = build.agg((F.count("*") > 0).alias("_any"), (F.count("*") > F.count(key)).alias("_nulls"))
    d = membership(build, probe, key, bits, hashes).join(known, F.col("maybe") & (F.col(key) == F.col("_known")), "left").crossJoin(F.broadcast(sizes))
    unknown = F.col("_any") & (F.col(key).isNull() | F.col("_nulls"))
    return d.select(key, F.when(F.col("_known").isNotNull(), True).when(~unknown, False).alias("maybe"))


def counting(d: DataFrame, key: str, change: str) -> DataFrame:
    """(key, n, member) of additions and removals, exact."""
    return d.groupBy(key).agg(F.sum(change).alias("n")).withColumn("member", F.col("n") > 0)
