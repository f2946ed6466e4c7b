"""Searches: the cheapest offer of each hotel, and the offers of one hotel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.criteria import SearchCriteria, condition
from wayfare.operators.ranking import numbered

#: The total order of offers: price, then everything that tells two offers apart.
ORDER = ("price", "outbound_departure", "inbound_departure", "outbound_departure_airport", "room_type", "meal_type", "ocean_view", "l_orderkey", "l_partkey", "l_linenumber")
SHOWN = ("hotel_id", "hotel_name", "hotel_stars", "min_price", "departure_date", "return_date", "room_type", "meal_type", "count_adults", "count_children", "duration", "available_offers")


def order_of(d: DataFrame) -> list[str]:
    return [c for c in ORDER if c in d.columns]


def matching(offers: DataFrame, c: SearchCriteria, hotels: DataFrame | None = None) -> DataFrame:
    """Offers that meet the criteria; with hotels, only of known hotels and of the stars asked for."""
    d = offers.where(condition(c))
    if hotels is None:
        return d
    h = hotels.where(F.col("stars").isin([float(s) for s in c.hotel_stars])) if c.hotel_stars else hotels
    return d.join(h.select(F.col("id").alias("hotel_id")), "hotel_id", "left_semi")


def cheapest(offers: DataFrame) -> DataFrame:
    """The first offer of each hotel in the total order, and the number of its offers: one aggregation, one exchange."""
    rest = [c for c in offers.columns if c not in ("hotel_id", *order_of(offers))]
    best = offers.groupBy("hotel_id").agg(F.min(F.struct(*order_of(offers), *rest)).alias("b"), F.count("*").alias("available_offers"))
    return best.select("hotel_id", "b.*", "available_offers")


def cheapest_by_rank(offers: DataFrame) -> DataFrame:
    """As cheapest(), by a window; Spark drops all but the first row of a hotel before the exchange (window group limit)."""
    first = offers.withColumn("rank", F.row_number().over(Window.partitionBy("hotel_id").orderBy(*order_of(offers)))).where("rank = 1").drop("rank")
    return first.join(offers.groupBy("hotel_id").agg(F.count("*").alias("available_offers")), "hotel_id")


def shown(best: DataFrame, name: Column | str = "name", stars: Column | str = "stars") -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return best.select(
        "hotel_id", col(name).alias("hotel_name"), col(stars).alias("hotel_stars"), F.col("price").alias("min_price"), F.col("outbound_departure").alias("departure_date"), F.col("inbound_departure").alias("return_date"),
        "room_type", "meal_type", "count_adults", "count_children", F.greatest(F.lit(0), F.datediff("inbound_departure", "outbound_departure")).cast("int").alias("duration"), "available_offers",
    )


def best_offers(offers: DataFrame, hotels: DataFrame, c: SearchCriteria, limit: int | None = None, rank: bool = False) -> DataFrame:
    """The cheapest matching offer of each known hotel, by price. The join comes after the aggregation, one row a hotel."""
    found = matching(offers, c, hotels if c.hotel_stars else None)
    best = (cheapest_by_rank if rank else cheapest)(found)
    out = shown(best.join(hotels, best.hotel_id == hotels.id)).orderBy("min_price", "hotel_id")
    return out.limit(limit) if limit else out


def best_offers_fallback(offers: DataFrame, hotels: DataFrame, c: SearchCriteria) -> DataFrame:
    """As best_offers(), but unknown hotels stay, named by their id and with four stars."""
    best = cheapest(matching(offers, c))
    d = best.join(hotels, best.hotel_id == hotels.id, "left")
    return shown(d, F.coalesce("name", F.concat(F.lit("Hotel "), F.col("hotel_id").cast("string"))), F.coalesce("stars", F.lit(4.0))).orderBy("min_price", "hotel_id")


def hotel_offers(offers: DataFrame, hotel_id: int, c: SearchCriteria, limit: int = 1000, offset: int = 0) -> DataFrame:
    """Matching offers of one hotel by price, at most ``limit`` of them, the interface's page."""
    d = offers.where((F.col("hotel_id") == hotel_id) & condition(c)).orderBy(*order_of(offers))
    return (d.offset(offset) if offset else d).limit(limit)


def chunks(best: DataFrame, size: int = 100) -> DataFrame:
    """best plus the number of its result chunk in the order of price."""
    return numbered(best, "min_price", ["min_price", "hotel_id"], "_rank").withColumn("chunk", F.floor(F.col("_rank") / size).cast("int")).drop("_rank")


def first_matches(offers: DataFrame, c: SearchCriteria, n: int) -> DataFrame:
    """The first n matching offers in the total order."""
    return matching(offers, c).orderBy(*order_of(offers)).limit(n)


def merge_results(parts: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Partial results as one: of rows of one hotel, price and departure the first stays; by price."""
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    rest = [c for c in d.columns if c not in ("hotel_id", "min_price", "departure_date")]
    d = d.groupBy("hotel_id", "min_price", "departure_date").agg(F.min(F.struct(*rest)).alias("x")).select("hotel_id", "min_price", "departure_date", "x.*").select(*d.columns).orderBy("min_price", "hotel_id", "departure_date")
    return d.limit(limit) if limit else d
