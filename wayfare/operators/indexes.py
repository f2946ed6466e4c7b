"""Index-like statistics and candidate sets, as aggregations and conjunctive filters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.codes import month0_key, month_key, passenger_key, price_bucket

AIRPORTS = ("outbound_departure_airport", "inbound_departure_airport", "outbound_arrival_airport", "inbound_arrival_airport")
#: Price ranges, closed on both ends, so that a boundary price is in two.
PRICE_RANGES = (("0-100", 0.0, 100.0), ("100-200", 100.0, 200.0), ("200-500", 200.0, 500.0), ("500-1000", 500.0, 1000.0), ("1000+", 1000.0, None))
KEY9 = ("hotel_id", "price", "count_adults", "count_children", "outbound_departure", "inbound_departure", "outbound_departure_airport", "meal_type", "room_type")
#: Bytes of an index entry in the memory estimate.
ENTRY_BYTES = 8


def counts(d: DataFrame, key, name: str) -> DataFrame:
    return d.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def offers_per_hotel(d: DataFrame) -> DataFrame:
    return d.groupBy("hotel_id").agg(F.count("*").alias("total_offers"))


def largest_hotel(d: DataFrame) -> DataFrame:
    return offers_per_hotel(d).orderBy(F.desc("total_offers"), "hotel_id").limit(1)


def airport_counts(d: DataFrame) -> DataFrame:
    """Posting-list lengths by departure airport; a row whose two are equal counts twice."""
    return counts(d.select(F.explode(F.array(*AIRPORTS[:2])).alias("a")), F.col("a"), "airport")


def airport_any_counts(d: DataFrame) -> DataFrame:
    """Rows by any of the four airports, each row once for an airport."""
    return counts(d.select(F.explode(F.array_distinct(F.array(*AIRPORTS))).alias("a")), F.col("a"), "airport")


def month_counts(d: DataFrame) -> DataFrame:
    return counts(d, month_key("outbound_departure"), "month")


def month0_counts(d: DataFrame) -> DataFrame:
    return counts(d, month0_key("outbound_departure"), "month")


def passenger_counts(d: DataFrame) -> DataFrame:
    return counts(d, passenger_key(), "passengers")


def price_range_counts(d: DataFrame) -> DataFrame:
    """Rows by price range in one pass: a row is exploded to the ranges that hold it."""
    hits = F.array_compact(F.array(*[F.when((F.col("price") >= lo) & (F.lit(True) if hi is None else F.col("price") <= hi), F.lit(n)) for n, lo, hi in PRICE_RANGES]))
    return counts(d.select(F.explode(hits).alias("r")), F.col("r"), "price_range")


def price_bucket_counts(d: DataFrame) -> DataFrame:
    return counts(d, price_bucket("price"), "bucket")


def index_stats(d: DataFrame) -> DataFrame:
    """One row of exact cardinalities: values by kind, combined before the shuffle, from one scan."""
    kinds = {"hotels": F.col("hotel_id").cast("string"), "months": month_key("outbound_departure"), "passenger_combos": passenger_key(), "meals": F.col("meal_type"), "rooms": F.col("room_type")}
    values = [F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()] + [F.struct(F.lit("airports").alias("kind"), F.col(a).alias("value")) for a in AIRPORTS[:2]]
    x = d.select(F.explode(F.array(*values)).alias("x")).select("x.*").groupBy("kind", "value").agg(F.count("*").alias("c"))
    of = lambda k: F.count(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    return x.agg(of("airports"), F.coalesce(F.sum(F.when(F.col("kind") == "hotels", F.col("c"))), F.lit(0)).cast("long").alias("offers"), *[of(k) for k in kinds])


def selectivity(d: DataFrame, **conditions) -> DataFrame:
    """(index_name, candidates, selectivity) of conditions, from one scan."""
    one = d.agg(F.count("*").alias("_n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("index_name"), F.col(k).alias("candidates")) for k in conditions]))
    return one.select("_n", rows.alias("x")).select("x.*", F.when(F.col("_n") > 0, F.col("x.candidates") / F.col("_n")).otherwise(0.0).alias("selectivity"))


def memory_estimate(d: DataFrame) -> DataFrame:
    """(index_name, entries, bytes): entries of the airport, month, passenger and hotel indexes."""
    one = d.agg(F.count("*").alias("n"))
    rows = [("airport", 2), ("hotel", 1), ("month", 1), ("passenger", 1)]
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("index_name"), (F.col("n") * m).alias("entries"), (F.col("n") * m * ENTRY_BYTES).alias("bytes")) for k, m in rows])).alias("x")).select("x.*")


def by_airports(d: DataFrame, codes) -> DataFrame:
    return d.where(F.col(AIRPORTS[0]).isin(list(codes)) | F.col(AIRPORTS[1]).isin(list(codes)))


def by_dates(d: DataFrame, earliest: datetime, latest: datetime) -> DataFrame:
    """Departures from ``earliest`` to the end of the day of ``latest``."""
    end = F.date_trunc("DAY", F.lit(latest.isoformat(sep=" ")).cast("timestamp_ntz")).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MILLISECOND")
    return d.where((F.col("outbound_departure") >= F.lit(earliest.isoformat(sep=" ")).cast("timestamp_ntz")) & (F.col("outbound_departure") <= end))


def by_passengers(d: DataFrame, adults: int, children: int) -> DataFrame:
    return d.where((F.col("count_adults") == adults) & (F.col("count_children") == children))


def index_intersection(d: DataFrame, codes, earliest: datetime, latest: datetime, adults: int, children: int) -> DataFrame:
    """Rows that are in the airport, date and passenger candidate sets: dates and passengers are part of the key, so a row is in
    those sets as soon as it meets them itself, and one scan with all filters settles it."""
    return by_passengers(by_dates(by_airports(d, codes), earliest, latest), adults, children)


def intersect(first: DataFrame, *others: DataFrame, keys=KEY9) -> DataFrame:
    """Rows of ``first`` whose key is in every other candidate set."""
    for o in others:
        first = first.join(o.select(*keys).distinct(), list(keys), "left_semi")
    return first


def dedupe(d: DataFrame, keys=KEY9, last: tuple[str, ...] = ("l_orderkey", "l_partkey", "l_linenumber")) -> DataFrame:
    """One row of each key: the last by the other columns given, without a window."""
    rest = [*last, *[c for c in d.columns if c not in keys and c not in last]]
    return d.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("x")).select(*keys, "x.*").select(*d.columns)


def bucket_search(d: DataFrame, hotel_ids=None, min_price=None, max_price=None, airports=None, limit: int = 1000) -> DataFrame:
    """Coarse search on price buckets: prices outside the bounds in an edge bucket stay; without criteria nothing is found."""
    if not (hotel_ids or airports or min_price is not None or max_price is not None):
        return d.limit(0)
    if hotel_ids:
        d = d.where(F.col("hotel_id").isin(list(hotel_ids)))
    if airports:
        d = d.where(F.col(AIRPORTS[0]).isin(list(airports)))
    if min_price is not None:
        d = d.where(price_bucket("price") >= int(min_price // 50 * 50))
    if max_price is not None:
        d = d.where(price_bucket("price") <= int(max_price // 50 * 50))
    return d.orderBy("hotel_id", "price", "outbound_departure", "l_orderkey", "l_partkey", "l_linenumber").limit(limit)


def filter_options(d: DataFrame) -> DataFrame:
    """(kind, value): distinct meals, rooms and departure airports from one scan."""
    kinds = {"airport": "outbound_departure_airport", "meal": "meal_type", "room": "room_type"}
    return d.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in kinds.items()])).alias("x")).select("x.*").distinct()


def bitset_counts(d: DataFrame) -> DataFrame:
    """(pair, n): cardinalities of bitmaps of hotel ids, and of their intersection and union by bitmap algebra.

    Buckets make any id fit; the null id, a value of its own to SQL's set operators, has a bucket beyond those of numbers.
    """
    bucket, bit = F.coalesce(F.bitmap_bucket_number("hotel_id"), F.lit(1 << 60)), F.coalesce(F.bitmap_bit_position("hotel_id"), F.lit(0).cast("long"))
    bits = lambda c: F.bitmap_construct_agg(F.when(c, bit))
    a, b = (F.col("outbound_departure_airport") == "FRA") & (F.col("price") < 100), (F.col("meal_type") == "Breakfast") & (F.col("price") > 2000)
    per = d.groupBy(bucket.alias("bucket")).agg(bits(a).alias("a"), bits(b).alias("b"))
    both = per.select("bucket", F.explode(F.array("a", "b")).alias("m")).groupBy("bucket").agg(F.bitmap_or_agg("m").alias("o"), F.bitmap_and_agg("m").alias("n"))
    d = per.join(both, "bucket").agg(F.sum(F.bitmap_count("a")).alias("first"), F.sum(F.bitmap_count("b")).alias("second"), F.sum(F.bitmap_count("n")).alias("both"), F.sum(F.bitmap_count("o")).alias("either"))
    return d
