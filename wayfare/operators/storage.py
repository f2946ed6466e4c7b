"""Tables by month of departure, and statistics of their layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.codes import month_key
from wayfare.operators.criteria import SearchCriteria, month_bounds
from wayfare.operators.ranking import ranked, text_bucket


def write_offers(offers: DataFrame, path: str, codec: str = "zstd", mode: str = "overwrite") -> None:
    """Offers as Parquet by month of departure, sorted by hotel in each file, so that both prune."""
    d = offers.withColumn("month_key", month_key("outbound_departure"))
    # by month, and large months dealt out in parts of the advised size
    d.hint("rebalance", "month_key").sortWithinPartitions("month_key", "hotel_id", "price").write.mode(mode).option("compression", codec).partitionBy("month_key").parquet(path)


def read_offers(spark: SparkSession, path: str, c: SearchCriteria | None = None) -> DataFrame:
    """The stored offers; with criteria, only the months that can match are read."""
    d = spark.read.parquet(path)
    return d.where(month_bounds(c)) if c else d


def dictionary_stats(d: DataFrame, columns) -> DataFrame:
    """(column_name, entries, bytes) of the dictionaries of string columns, from one scan."""
    x = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in columns])).alias("x")).select("x.*").distinct()
    return x.groupBy("column_name").agg(F.count("*").alias("entries"), F.sum(F.octet_length("v")).cast("long").alias("bytes"))


def dictionary(d: DataFrame, column: str) -> DataFrame:
    """(value, code): codes of the distinct values in their order."""
    return ranked(d.select(F.col(column).alias("value")).distinct(), text_bucket(F.col("value").cast("string")), ["value"], "code")


def smallest_width(most: Column) -> Column:
    """Bits of the smallest array that holds numbers up to ``most``."""
    return F.when(most <= 255, 8).when(most <= 65535, 16).otherwise(32)


def by_positions(d: DataFrame, position: str, positions: DataFrame) -> DataFrame:
    """The rows at the given positions, ``positions(position)``; a position that is asked for twice comes once."""
    return d.join(positions.select(F.col("position").alias(position)).distinct(), position, "left_semi")


def block_stats(d: DataFrame, rows: int = 10_000) -> DataFrame:
    """One row: rows, blocks of ``rows`` and the size of the last one."""
    n = F.count("*")
    return d.agg(n.alias("offers"), F.ceil(n / rows).cast("long").alias("blocks"), F.when(n == 0, 0).otherwise((n - 1) % rows + 1).cast("long").alias("last_block"))
