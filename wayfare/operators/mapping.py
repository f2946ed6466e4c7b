"""Offers against the hotel dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.functions.codes import hash31


def known(offers: DataFrame, hotels: DataFrame) -> DataFrame:
    return offers.join(hotels, offers.hotel_id == hotels.id, "left_semi")


def orphans(offers: DataFrame, hotels: DataFrame) -> DataFrame:
    """(hotel_id, orphan_offers) of hotels that are not known."""
    return offers.join(hotels, offers.hotel_id == hotels.id, "left_anti").groupBy("hotel_id").agg(F.count("*").alias("orphan_offers"))


def stats(offers: DataFrame, hotels: DataFrame) -> DataFrame:
    """One row over the distinct hotel ids of offers: total, matched, unmatched, match_rate (1 where there are none)."""
    ids = offers.select("hotel_id").distinct().join(hotels.select(F.col("id")), F.col("hotel_id") == F.col("id"), "left")
    d = ids.agg(F.count("*").alias("total"), F.count("id").alias("matched"))
    return d.select("total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"), F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(0.0).alias("match_rate"))


def with_fallback(ids: DataFrame, hotels: DataFrame) -> DataFrame:
    """(hotel_id, name, stars, is_mapped): unknown hotels are named by their id and get three to five stars from its hash."""
    d = ids.select("hotel_id").distinct().join(hotels, F.col("hotel_id") == F.col("id"), "left")
    text = F.col("hotel_id").cast("string")
    return d.select("hotel_id", F.coalesce("name", F.concat(F.lit("Hotel "), text)).alias("name"), F.coalesce("stars", (3 + F.abs(hash31(text)) % 3).cast("double")).alias("stars"), F.col("id").isNotNull().alias("is_mapped"))
