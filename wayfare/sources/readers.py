"""CSV sources: rows, rejects and statistics. Every reader takes text columns, so that dirt is judged row by row."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.parsing import parse_boolean, parse_date, parse_integer, parse_number, parse_prefix_integer, strict_true, unquote

#: Column orders and names of the file formats.
NAMED = ("hotelid", "price", "countadults", "countchildren", "departuredate", "returndate", "outbounddepartureairport", "inbounddepartureairport", "outboundarrivalairport", "inboundarrivalairport", "mealtype", "oceanview", "roomtype")
NAMED_OPTIONAL = ("outboundarrivaldatetime", "inboundarrivaldatetime")
POSITIONS_15 = ("hotelid", "departuredate", "returndate", "countadults", "countchildren", "price", "inbounddepartureairport", "inboundarrivalairport", "inboundarrivaldatetime", "outbounddepartureairport", "outboundarrivalairport", "outboundarrivaldatetime", "mealtype", "oceanview", "roomtype")
POSITIONS_14 = ("hotelid", "departuredate", "returndate", "countadults", "countchildren", "price", "outbounddepartureairport", "inbounddepartureairport", "outboundarrivalairport", "inboundarrivalairport", "mealtype", "roomtype", "duration", "oceanview")
OFFERS = [
    "hotel_id", "price", "count_adults", "count_children", "outbound_departure", "inbound_departure", "outbound_arrival", "inbound_arrival", "outbound_departure_airport",
    "inbound_departure_airport", "outbound_arrival_airport", "inbound_arrival_airport", "meal_type", "ocean_view", "room_type", "duration",
]
HOTELS = ("hotelid", "hotelname", "hotelstars")


class Loaded(NamedTuple):
    """Valid rows; rejected rows with ``errors``; one row of counts."""

    valid: DataFrame
    rejects: DataFrame
    stats: DataFrame


def _split(d: DataFrame, parts: dict[str, Column], bad: dict[str, Callable[[Column], Column]], first: dict[str, Column] | None = None) -> Loaded:
    """parts: the typed columns; bad: which values of a column, beside nulls, reject a row; first: columns that several parts use.

    Everything is parsed in generated code; the row then passes a generator, which filters do not cross, so it is parsed once.
    Bounds and empty texts are judged behind it, which keeps the parsing methods small enough for the compiler.
    """
    raw = [F.col(c).alias(f"raw_{c}") for c in d.columns]
    if first:
        d = d.withColumns(first)
    d = d.select(*raw, *[c.alias(k) for k, c in parts.items()])
    raw = [c for c in d.columns if c.startswith("raw_")]
    d = d.select(F.explode(F.array(F.struct(*parts))).alias("p"), *raw)
    wrong = {k: F.col("p")[k].isNull() | test(F.col("p")[k]) for k, test in bad.items()}
    ok = ~reduce(or_, wrong.values())
    stats = d.agg(F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("errors")).withColumn("success_rate", F.when(F.col("total") > 0, F.col("valid") / F.col("total")).otherwise(0.0))
    errors = F.array_compact(F.array(*[F.when(c, F.lit(f"{k} is missing or malformed")) for k, c in wrong.items()]))
    return Loaded(d.where(ok).select("p.*"), d.where(~ok).select(*raw, errors.alias("errors")), stats)


def _text(name: str) -> Column:
    return F.trim(unquote(F.col(name)))


_EMPTY, _NEGATIVE, _ANY = (lambda c: c == ""), (lambda c: c < 0), (lambda c: F.lit(False))


def parse_offers(d: DataFrame, booleans: str = "strict", integers: str = "strict") -> Loaded:
    """Offers from text columns with the names of NAMED; arrivals default to two hours after departure.

    booleans: "strict" takes only ``true`` as true, "lax" knows yes, no, 1 and 0. integers: "prefix" takes a leading number.
    """
    whole = parse_integer if integers == "strict" else parse_prefix_integer
    two = F.expr("INTERVAL 2 HOURS")
    arrive = lambda c, leave: F.coalesce(parse_date(F.col(c)), leave + two) if c in d.columns else leave + two
    ocean = F.lit(False) if "oceanview" not in d.columns else strict_true(F.col("oceanview")) if booleans == "strict" else F.coalesce(parse_boolean(F.col("oceanview")), F.lit(False))

    out, back = F.col("_out"), F.col("_back")
    nights = F.greatest(F.lit(0), F.datediff(back, out))
    parts = {
        "hotel_id": whole(F.col("hotelid")), "price": parse_number(F.col("price")), "count_adults": whole(F.col("countadults")).cast("int"), "count_children": whole(F.col("countchildren")).cast("int"),
        "outbound_departure": out, "inbound_departure": back, "outbound_arrival": arrive("outboundarrivaldatetime", out), "inbound_arrival": arrive("inboundarrivaldatetime", back),
        "outbound_departure_airport": _text("outbounddepartureairport"), "inbound_departure_airport": _text("inbounddepartureairport"), "outbound_arrival_airport": _text("outboundarrivalairport"), "inbound_arrival_airport": _text("inboundarrivalairport"),
        "meal_type": _text("mealtype"), "ocean_view": ocean, "room_type": _text("roomtype"),
        "duration": F.coalesce(parse_integer(F.col("duration")).cast("int"), nights) if "duration" in d.columns else nights,
    }
    bad = {k: _NEGATIVE if k in ("hotel_id", "price", "count_adults", "count_children") else _EMPTY if k.endswith(("airport", "type")) else _ANY for k in OFFERS}
    return _split(d, parts, bad, {"_out": parse_date(F.col("departuredate")), "_back": parse_date(F.col("returndate"))})


def parse_hotels(d: DataFrame) -> Loaded:
    stars = parse_number(unquote(F.col("hotelstars")))
    i = parse_integer(unquote(F.col("hotelid")))
    return _split(d, {"id": i, "name": _text("hotelname"), "stars": stars}, {"id": lambda c: c <= 0, "name": _EMPTY, "stars": lambda c: ~c.between(0, 5)})


def _csv(spark: SparkSession, path: str, sep: str, names: tuple[str, ...] | None) -> DataFrame:
    r = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
    if names is None:
        d = r.option("header", True).option("inferSchema", False).csv(path)
        return d.toDF(*[c.strip().lower() for c in d.columns])
    return r.schema(", ".join(f"{n} string" for n in names)).option("header", True).option("enforceSchema", True).csv(path)


def read_hotels(spark: SparkSession, path: str) -> Loaded:
    d = _csv(spark, path, ";", None)
    if missing := [c for c in HOTELS if c not in d.columns]:
        raise ValueError(f"hotels file lacks columns {missing}")
    return parse_hotels(d)


def read_offers_named(spark: SparkSession, path: str, sep: str = ",") -> Loaded:
    """Offers with a header; a file without the required names is rejected as a whole."""
    d = _csv(spark, path, sep, None)
    if missing := [c for c in NAMED if c not in d.columns]:
        raise ValueError(f"offers file lacks columns {missing}")
    return parse_offers(d)


def split_lines(lines: DataFrame, names: tuple[str, ...], sep: str) -> DataFrame:
    """The text columns of lines(line) of a file without a usable header, by position; a line that is too short has nulls."""
    kind = ", ".join(f"{n} string" for n in names)
    return lines.select(F.from_csv("line", kind, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("r")).select("r.*")


def parse_pos15(lines: DataFrame) -> Loaded:
    return parse_offers(split_lines(lines, POSITIONS_15, ","), "lax", "prefix")


def parse_pos14(lines: DataFrame) -> Loaded:
    return parse_offers(split_lines(lines, POSITIONS_14, ";"), "lax")


def read_offers_pos15(spark: SparkSession, path: str) -> Loaded:
    return parse_offers(_csv(spark, path, ",", POSITIONS_15), "lax", "prefix")


def read_offers_pos14(spark: SparkSession, path: str) -> Loaded:
    return parse_offers(_csv(spark, path, ";", POSITIONS_14), "lax")


def mock_hotels(spark: SparkSession, n: int = 100) -> DataFrame:
    """Stand-ins for a missing hotels file."""
    i = F.col("i")
    return spark.range(1, n + 1).select(F.col("id").alias("i")).select(i.alias("id"), F.concat(F.lit("Hotel "), i.cast("string")).alias("name"), (3 + i % 3).cast("double").alias("stars"))


def load(spark: SparkSession, hotels_path: str, offers_path: str, store_path: str) -> tuple[DataFrame, DataFrame]:
    """Reads both files and stores the offers of known hotels by month; gives the hotels and the counts of the offers."""
    from wayfare.operators.mapping import known
    from wayfare.operators.storage import write_offers

    hotels, offers = read_hotels(spark, hotels_path), read_offers_named(spark, offers_path)
    write_offers(known(offers.valid, hotels.valid), store_path)
    return hotels.valid, offers.stats
