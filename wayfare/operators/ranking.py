"""Order statistics without a window over all rows: counts by a coarse bucket first, then windows inside the buckets.

A bucket is a monotonous function of the order's first column with at most ``BUCKETS`` values, so the only single task
adds up one row for each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def _before(per: DataFrame, by: str, n: str) -> DataFrame:
    """per plus ``before``: the sum of n over lesser buckets; per has one row for each bucket."""
    w = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0).cast("long")))


def number_bucket(x: Column, lo: Column, hi: Column) -> Column:
    """The bucket of a number between lo and hi; of a null the first."""
    share = F.try_divide(x.cast("double") - lo, hi.cast("double") - lo)
    return F.when(x.isNull(), -1).otherwise(F.coalesce(F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)), F.lit(0))).cast("int")


def text_bucket(x: Column) -> Column:
    """The first two bytes of a text, which order texts as Spark does."""
    return F.coalesce(F.substring(F.encode(x, "UTF-8"), 1, 2), F.lit(b""))


def ranked(d: DataFrame, bucket: Column, order: list, name: str = "rank") -> DataFrame:
    """d plus the row number, from 0, in the order; bucket must follow the order."""
    d = d.withColumn("_bucket", bucket)
    per = _before(d.groupBy("_bucket").agg(F.count("*").alias("_n")), "_bucket", "_n").select("_bucket", F.col("before").alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return d.withColumn("_inside", inside).join(F.broadcast(per), d["_bucket"].eqNullSafe(per["_bucket"])).withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def numbered(d: DataFrame, by: str, order: list, name: str = "rank") -> DataFrame:
    """As ranked(), by buckets of a numeric column between its least and greatest value."""
    ends = d.agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    out = ranked(d.join(F.broadcast(ends)), number_bucket(F.col(by), F.col("_lo"), F.col("_hi")), order, name)
    return out.drop("_lo", "_hi")


def quantiles(d: DataFrame, column: str, points) -> DataFrame:
    """(p, value): of each p the least value up to which at least that share of the rows lies; nulls do not count."""
    v = d.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    one = v.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("c").alias("n"))
    v = v.join(F.broadcast(one)).select("value", "c", "n", number_bucket(F.col("value"), F.col("lo"), F.col("hi")).alias("b"))
    per = _before(v.groupBy("b").agg(F.sum("c").alias("cb"), F.first("n").alias("n")), "b", "cb")
    p = F.explode(F.array(*map(F.lit, points))).alias("p")
    at = per.select("b", "before", "cb", "n", p).where((F.col("before") + F.col("cb")) / F.col("n") >= F.col("p"))
    at = at.groupBy("p").agg(F.min(F.struct("b", "before")).alias("x")).select("p", F.col("x.b").alias("b"), "x.before")
    run = F.sum("c").over(Window.partitionBy("p").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    hit = v.join(F.broadcast(at), "b").withColumn("upto", F.col("before") + run).where(F.col("upto") / F.col("n") >= F.col("p"))
    return hit.groupBy("p").agg(F.min("value").alias("value"))
