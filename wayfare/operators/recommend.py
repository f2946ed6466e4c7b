"""Recommendations: scores over the cheapest offer of each hotel, the k best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions.codes import number_text, round_half_up


def _when(c: Column, points: float) -> Column:
    return F.when(c, F.lit(float(points))).otherwise(0.0)


def _reasons(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]))


def _top(d: DataFrame, score: Column, reasons: Column, k: int) -> DataFrame:
    d = d.select("hotel_id", "hotel_name", "hotel_stars", "min_price", round_half_up(score).alias("score"), reasons.alias("reasons"))
    return d.orderBy(F.desc("score"), "min_price", "hotel_id").limit(k)


def _columns() -> tuple[Column, Column, Column]:
    return F.col("hotel_stars"), F.col("min_price"), F.col("available_offers")


def personalized(best: DataFrame, has_shortlist: DataFrame, k: int = 10) -> DataFrame:
    """has_shortlist: one row with the boolean ``liked``, whether the user has any shortlist item."""
    stars, price, many = _columns()
    d = best.join(F.broadcast(has_shortlist.select("liked").limit(1)))
    cheap = F.greatest(F.lit(0.0), 3.0 - price / 1000.0)
    sea = F.lower("room_type").contains("ocean") | F.lower("room_type").contains("sea")
    full, long_, liked = F.col("meal_type") == "All Inclusive", F.col("duration") >= 7, F.col("liked")
    score = stars + cheap + _when(sea, 1) + _when(full, 1) + _when(liked, 0.5) + _when(long_, 0.5) + _when(many > 10, 0.5)
    reasons = _reasons((stars >= 4, F.concat(number_text(stars), F.lit("-star hotel"))), (cheap >= 2, "Great price"), (sea, "Ocean view"), (full, "All inclusive"), (liked, "Matches your preferences"), (long_, "Perfect for longer stays"), (many > 10, "Great availability"))
    return _top(d, score, reasons, k)


def similar(best: DataFrame, hotels: DataFrame, hotel_id: int, k: int = 5) -> DataFrame:
    """Hotels of like stars; an unknown hotel has none."""
    stars, _, _ = _columns()
    own = hotels.where(F.col("id") == hotel_id).select(F.col("stars").alias("own")).limit(1)
    d = best.where(F.col("hotel_id") != hotel_id).join(F.broadcast(own))
    diff = F.abs(stars - F.col("own"))
    reasons = _reasons((diff == 0, "Same star rating"), ((diff > 0) & (diff <= 0.5), "Similar star rating"), (F.lit(True), "Similar hotel type"))
    return _top(d, F.greatest(F.lit(0.0), 5.0 - diff) + 2.0, reasons, k)


def trending(best: DataFrame, k: int = 10) -> DataFrame:
    stars, price, many = _columns()
    full = F.col("meal_type") == "All Inclusive"
    score = _when(stars >= 4.5, 3) + _when(many > 15, 2) + _when(price < 500, 2) + _when(full, 1)
    reasons = _reasons((stars >= 4.5, "Highly rated"), (many > 15, "High availability"), (price < 500, "Competitive pricing"), (full, "All inclusive package"), (F.lit(True), "Trending destination"))
    return _top(best, score, reasons, k)


def value_deals(best: DataFrame, k: int = 10) -> DataFrame:
    stars, price, many = _columns()
    full, unit = F.col("meal_type") == "All Inclusive", price / 100.0
    value = F.when(unit > 0, stars / F.nullif(unit, F.lit(0.0)) * 10.0).otherwise(0.0)
    reasons = _reasons((full, "All inclusive value"), (many > 10, "Good availability"), (F.lit(True), "Great value for money"))
    return _top(best, value + _when(full, 2) + _when(many > 10, 1), reasons, k)
