"""Search criteria: a record, its predicates, its validation and its reduced forms."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SearchCriteria:
    """All given conditions hold together; None asks for nothing, an empty list of airports neither."""

    departure_airports: tuple[str, ...] = ()
    earliest_departure: datetime | None = None
    latest_return: datetime | None = None
    duration: int | None = None
    count_adults: int | None = None
    count_children: int | None = None
    meal_types: tuple[str, ...] | None = None
    room_types: tuple[str, ...] | None = None
    ocean_view: bool | None = None
    min_price: float | None = None
    max_price: float | None = None
    hotel_stars: tuple[float, ...] | None = None
    hotel_ids: tuple[int, ...] | None = None
    duration_mode: str = "nights"


STANDARD = SearchCriteria(("FRA", "MUC"), datetime(1996, 1, 1), datetime(2001, 12, 31), 7, 2, 0)


def nights() -> Column:
    """Midnights between the departures, never negative."""
    return F.greatest(F.lit(0), F.datediff("inbound_departure", "outbound_departure"))


def elapsed_days() -> Column:
    """Elapsed time in days, rounded up."""
    return F.expr("CAST(ceil(timestampdiff(MILLISECOND, outbound_departure, inbound_departure) / 86400000D) AS INT)")


def airports(codes) -> Column:
    return F.col("outbound_departure_airport").isin(list(codes))


def departs_from(when: datetime) -> Column:
    return F.col("outbound_departure") >= F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def returns_by(when: datetime) -> Column:
    return F.col("inbound_departure") <= F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def predicates(c: SearchCriteria) -> list[Column]:
    """The conditions on offers; the condition on stars needs the hotel and is applied by the search."""
    out: list[Column] = []
    if c.departure_airports:
        out.append(airports(c.departure_airports))
    if c.earliest_departure is not None:
        out.append(departs_from(c.earliest_departure))
    if c.latest_return is not None:
        out.append(returns_by(c.latest_return))
    if c.duration is not None:
        out.append((nights() if c.duration_mode == "nights" else elapsed_days()) == c.duration)
    for name in ("count_adults", "count_children", "ocean_view"):
        if (v := getattr(c, name)) is not None:
            out.append(F.col(name) == F.lit(v))
    if c.meal_types:
        out.append(F.col("meal_type").isin(list(c.meal_types)))
    if c.room_types:
        out.append(F.col("room_type").isin(list(c.room_types)))
    if c.min_price is not None:
        out.append(F.col("price") >= c.min_price)
    if c.max_price is not None:
        out.append(F.col("price") <= c.max_price)
    if c.hotel_ids is not None:
        out.append(F.col("hotel_id").isin(list(c.hotel_ids)))
    return out


def condition(c: SearchCriteria) -> Column:
    return reduce(and_, predicates(c), F.lit(True))


def month_bounds(c: SearchCriteria, column: str = "month_key") -> Column:
    """The redundant condition on a table partitioned by month of departure, so that Spark prunes partitions."""
    out = F.lit(True)
    if c.earliest_departure is not None:
        out = out & (F.col(column) >= c.earliest_departure.strftime("%Y-%m"))
    if c.latest_return is not None:
        out = out & (F.col(column) <= c.latest_return.strftime("%Y-%m"))
    return out


def degrade(c: SearchCriteria, level: str) -> SearchCriteria:
    """Criteria cut down under memory pressure: fewer airports, and 30 days at most when it is high or critical."""
    most = {"low": None, "medium": 5, "high": 3, "critical": 1}[level]
    if most is None:
        return c
    out = replace(c, departure_airports=c.departure_airports[:most])
    if level in ("high", "critical") and c.earliest_departure and c.latest_return:
        out = replace(out, latest_return=min(c.latest_return, c.earliest_departure + timedelta(days=30)))
    return out


def errors(rules: list[tuple[Column, str]]) -> Column:
    """The messages of the rules that a row breaks, in order; a condition that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in rules]))


def validate_criteria(d: DataFrame) -> DataFrame:
    """d plus ``errors``: columns as in SearchCriteria, airports as an array, null where not given."""
    given = lambda c, ok: F.col(c).isNull() | ok
    return d.withColumn("errors", errors([
        (F.size("departure_airports") > 0, "at least one departure airport is required"),
        (F.forall("departure_airports", lambda a: F.length(a) == 3), "airports must have three letters"),
        (F.col("earliest_departure").isNotNull(), "earliest departure is required"),
        (F.col("latest_return").isNotNull(), "latest return is required"),
        (F.coalesce(F.col("earliest_departure") < F.col("latest_return"), F.lit(True)), "earliest departure must be before latest return"),
        (F.col("duration").between(1, 365), "duration must be 1 to 365"),
        (F.col("count_adults").between(1, 10), "adults must be 1 to 10"),
        (F.col("count_children").between(0, 10), "children must be 0 to 10"),
        (given("min_price", F.col("min_price") >= 0), "minimum price must not be negative"),
        (given("max_price", F.col("max_price") >= 0), "maximum price must not be negative"),
        (F.coalesce(F.col("min_price") <= F.col("max_price"), F.lit(True)), "minimum price must not exceed maximum price"),
        (given("stars", F.col("stars").between(0, 5)), "stars must be 0 to 5"),
    ]))


def validate_hotel_id(d: DataFrame, column: str = "hotel_id") -> DataFrame:
    """d plus ``valid``: the text is a positive integer without leading zeros."""
    return d.withColumn("valid", F.coalesce(F.col(column).rlike("^[1-9][0-9]*$"), F.lit(False)))


def validate_offers(d: DataFrame) -> DataFrame:
    """d plus ``errors``: numbers not negative, texts not empty, dates present."""
    rules = [(F.col(c) >= 0, f"{c} must not be negative") for c in ("hotel_id", "price", "count_adults", "count_children", "duration")]
    rules += [(F.length(F.trim(c)) > 0, f"{c} is required") for c in ("outbound_departure_airport", "inbound_departure_airport", "outbound_arrival_airport", "inbound_arrival_airport", "meal_type", "room_type")]
    rules += [(F.col(c).isNotNull(), f"{c} is required") for c in ("outbound_departure", "inbound_departure", "outbound_arrival", "inbound_arrival", "ocean_view")]
    return d.withColumn("errors", errors(rules))


def validate_hotels(d: DataFrame) -> DataFrame:
    """d plus ``errors``."""
    return d.withColumn("errors", errors([(F.col("id") > 0, "id must be positive"), (F.length(F.trim("name")) > 0, "name is required"), (F.col("stars").between(0, 5), "stars must be 0 to 5")]))
