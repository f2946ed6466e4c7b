"""Offers, hotels and event logs as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hotels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, stars); a tenth of the ids that offers use is missing on purpose."""
    return table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 7").select(
        (F.col("s_suppkey") + 1).cast("long").alias("id"), F.col("s_name").alias("name"), F.expr("CAST(1.0D + (s_suppkey % 9) * 0.5D AS DOUBLE)").alias("stars")
    )


OFFER_COLUMNS = {
    "hotel_id": "CAST(l_suppkey + 1 AS BIGINT)",
    "price": "CAST(l_extendedprice / 50.0D AS DOUBLE)",
    "count_adults": "CAST(1 + l_linenumber % 4 AS INT)",
    "count_children": "CAST(CAST(l_quantity AS INT) % 3 AS INT)",
    "outbound_departure": "l_shipdate + make_dt_interval(0, CAST(l_partkey % 24 AS INT), 0, 0)",
    "inbound_departure": "l_shipdate + make_dt_interval(CAST(1 + l_orderkey % 14 AS INT), CAST(l_quantity AS INT) % 24, 0, 0)",
    "outbound_departure_airport": "CASE l_partkey % 6 WHEN 0 THEN 'FRA' WHEN 1 THEN 'MUC' WHEN 2 THEN 'DUS' WHEN 3 THEN 'HAM' WHEN 4 THEN 'BER' ELSE 'CGN' END",
    "meal_type": "CASE l_returnflag WHEN 'A' THEN 'All Inclusive' WHEN 'N' THEN 'Half Board' ELSE 'Breakfast' END",
    "ocean_view": "l_linestatus = 'F'",
    "room_type": "CASE l_linenumber % 4 WHEN 0 THEN 'Suite' WHEN 1 THEN 'Double Room' WHEN 2 THEN 'Ocean View Room' ELSE 'Family Room' END",
}
KEYS = ("l_orderkey", "l_partkey", "l_linenumber")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offers relation, with the source keys for tie-breaks."""
    d = table(spark, sf_dir, "lineitem").select(*[F.expr(e).alias(k) for k, e in OFFER_COLUMNS.items()], *KEYS)
    two = F.expr("INTERVAL 2 HOURS")
    return d.withColumns({
        "outbound_arrival": F.col("outbound_departure") + two,
        "inbound_arrival": F.col("inbound_departure") + two,
        "inbound_departure_airport": F.when(F.col("l_linenumber") == 7, F.col("outbound_departure_airport")).otherwise("PMI"),
        "outbound_arrival_airport": F.when(F.col("l_linenumber") == 7, F.col("outbound_departure_airport")).otherwise("PMI"),
        "inbound_arrival_airport": F.col("outbound_departure_airport"),
        "duration": F.greatest(F.lit(0), F.datediff("inbound_departure", "outbound_departure")).cast("int"),
    })


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, user_id, hotel_id, action, price, target_price, notes): mutations of shortlists and alerts."""
    action = F.expr("CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'alert' END")
    return events(spark, sf_dir).select(
        "event_id", "ts", "user_id", F.expr("CAST(1 + event_id % 100 AS BIGINT)").alias("hotel_id"), action.alias("action"),
        F.expr("value * 4").alias("price"), F.expr("500 + value").alias("target_price"), F.col("props").alias("notes"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, endpoint, duration_ms, user_id)."""
    return events(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("endpoint"), F.expr("value * 20").alias("duration_ms"), "user_id")


def life_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As user_log(), with ``alert_id``, and with actions that delete shortlists and change alerts."""
    decade = "event_id DIV 10"
    action = f"""CASE event_id % 10 WHEN 0 THEN 'create' WHEN 1 THEN 'add' WHEN 2 THEN 'add' WHEN 3 THEN 'note' WHEN 4 THEN 'remove'
        WHEN 5 THEN CASE WHEN {decade} % 3 = 0 THEN 'delete' ELSE 'add' END WHEN 6 THEN 'alert' WHEN 7 THEN CASE WHEN {decade} % 2 = 0 THEN 'deactivate' ELSE 'trigger' END
        WHEN 8 THEN CASE WHEN {decade} % 3 = 0 THEN 'activate' END ELSE CASE WHEN {decade} % 5 = 0 THEN 'delete_alert' END END"""
    return events(spark, sf_dir).select(
        "event_id", "ts", F.expr(f"({decade}) % 40").alias("user_id"), F.expr(f"CAST(1 + ({decade} + event_id % 3) % 20 AS BIGINT)").alias("hotel_id"), F.expr("event_id - event_id % 10 + 6").alias("alert_id"),
        F.expr("value * 4").alias("price"), F.expr("500 + value").alias("target_price"), F.col("props").alias("notes"), F.expr(action).alias("action"),
    )
