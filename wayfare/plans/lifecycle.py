"""Queries over the life of shortlists and alerts, positional files, further dates, keys and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import codes, parsing
from wayfare.operators import metrics, sketches, storage, userstate
from wayfare.plans.oracles import _ITEMS, _MESSAGE, _VIEWS
from wayfare.sources.fixtures import events, life_log, offers, table

NOW = "TIMESTAMP_NTZ '2024-06-01 00:00:00'"


def lifecycle_items(s: SparkSession, d: str) -> DataFrame:
    return userstate.shortlist_items(userstate.since_deletion(life_log(s, d)))


def lifecycle_shortlists(s: SparkSession, d: str) -> DataFrame:
    return userstate.user_shortlists(userstate.since_deletion(life_log(s, d)))


def lifecycle_notes(s: SparkSession, d: str) -> DataFrame:
    return userstate.item_notes(userstate.since_deletion(life_log(s, d)))


def lifecycle_alerts(s: SparkSession, d: str) -> DataFrame:
    return userstate.alert_states(life_log(s, d))


def lifecycle_triggered(s: SparkSession, d: str) -> DataFrame:
    prices = offers(s, d).groupBy("hotel_id").agg(F.min("price").alias("min_price"))
    return userstate.trigger(userstate.alert_states(life_log(s, d)), prices, F.expr(NOW))


def parse_dates_more(s: SparkSession, d: str) -> DataFrame:
    """The forms with T, with a blank, with an offset, and what is no date."""
    forms = "CASE event_id % 7 WHEN 0 THEN date_format(ts, \"dd/MM/yyyy'T'HH:mm:ss\") WHEN 1 THEN date_format(ts, \"dd-MM-yyyy'T'HH:mm:ss\") WHEN 2 THEN date_format(ts, 'dd/MM/yyyy HH:mm:ss') WHEN 3 THEN date_format(ts, 'dd-MM-yyyy HH:mm:ss') WHEN 4 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") WHEN 5 THEN concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00') ELSE '31/31/2024T00:00:00' END"
    return events(s, d).select("event_id", parsing.parse_date(F.expr(forms)).alias("parsed"))


def same_day_pairs(s: SparkSession, d: str) -> DataFrame:
    two = F.expr("ts + INTERVAL 6 HOURS")
    return events(s, d).groupBy(parsing.same_day(F.col("ts"), two).alias("same")).agg(F.count("*").alias("n"))


def prefix_numbers(s: SparkSession, d: str) -> DataFrame:
    t = F.expr("CASE event_id % 4 WHEN 0 THEN concat(event_id, '.5abc') WHEN 1 THEN concat(' -', event_id, 'e1x') WHEN 2 THEN 'x1' ELSE '.25' END")
    return events(s, d).select("event_id", parsing.parse_prefix_number(t).alias("number"))


def criteria_key(s: SparkSession, d: str) -> DataFrame:
    """Two orders of the same fields have one key."""
    fields = {"duration": F.lit(7), "airports": codes.sorted_values(F.array(F.lit("MUC"), F.lit("FRA"), F.col("event_type"))), "earliest": codes.epoch_ms(F.col("ts"))}
    one, two = codes.criteria_key(fields), codes.criteria_key(dict(reversed(fields.items())))
    return events(s, d).select("event_id", one.alias("key"), (one == two).alias("same"))


def error_severities(s: SparkSession, d: str) -> DataFrame:
    return metrics.error_severity_stats(events(s, d).select(F.expr(_MESSAGE).alias("message"), (F.col("event_id") % 2 == 0).alias("resolved")))


def duplicate_hotels(s: SparkSession, d: str) -> DataFrame:
    """Hotel ids that stand in several rows of a file."""
    h = table(s, d, "supplier").select(F.expr("CAST(s_suppkey DIV 2 * 2 + s_nationkey % 2 AS BIGINT)").alias("id"))
    return h.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def memory_alerts(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy(metrics.memory_alert(F.col("event_id") % 100).alias("alert")).agg(F.count("*").alias("n"))


def complex_searches(s: SparkSession, d: str) -> DataFrame:
    early, late = F.expr("CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END"), F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END")
    return events(s, d).groupBy(metrics.complex_criteria(F.col("event_id") % 9, early, late).alias("complex")).agg(F.count("*").alias("n"))


def array_widths(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).groupBy(storage.smallest_width(F.col("event_id") * 50).alias("bits")).agg(F.count("*").alias("n"))


def rows_by_position(s: SparkSession, d: str) -> DataFrame:
    want = events(s, d).where("event_id % 13 = 0").select(F.col("event_id").alias("position"))
    return storage.by_positions(events(s, d).select("event_id", "user_id", "value"), "event_id", want.union(want))


def dictionary_codes(s: SparkSession, d: str) -> DataFrame:
    return storage.dictionary(offers(s, d), "room_type")


def bloom_generations(s: SparkSession, d: str) -> DataFrame:
    """Each generation of a growing filter holds twice the keys at half the rate."""
    g = s.range(6).select(F.col("id").alias("generation"), (1000 * F.pow(F.lit(2.0), F.col("id"))).alias("n"), (F.lit(0.01) * F.pow(F.lit(0.5), F.col("id"))).alias("p"))
    size = sketches.sizing(F.col("n"), F.col("p"))
    return g.select("generation", F.col("n").cast("long").alias("keys"), size["bits"].alias("bits"), size["hashes"].alias("hashes"))


QUERIES = {
    f.__name__: f
    for f in (lifecycle_items, lifecycle_shortlists, lifecycle_notes, lifecycle_alerts, lifecycle_triggered, parse_dates_more, same_day_pairs, prefix_numbers, criteria_key, error_severities,
              duplicate_hotels, memory_alerts, complex_searches, array_widths, rows_by_position, dictionary_codes, bloom_generations)
}

_LIFE = """life AS (
  SELECT event_id, ts, (event_id // 10) % 40 AS user_id, CAST(1 + (event_id // 10 + event_id % 3) % 20 AS BIGINT) AS hotel_id, event_id - event_id % 10 + 6 AS alert_id, value * 4 AS price, 500 + value AS target_price, props AS notes,
    CASE event_id % 10 WHEN 0 THEN 'create' WHEN 1 THEN 'add' WHEN 2 THEN 'add' WHEN 3 THEN 'note' WHEN 4 THEN 'remove' WHEN 5 THEN CASE WHEN event_id // 10 % 3 = 0 THEN 'delete' ELSE 'add' END WHEN 6 THEN 'alert'
      WHEN 7 THEN CASE WHEN event_id // 10 % 2 = 0 THEN 'deactivate' ELSE 'trigger' END WHEN 8 THEN CASE WHEN event_id // 10 % 3 = 0 THEN 'activate' END ELSE CASE WHEN event_id // 10 % 5 = 0 THEN 'delete_alert' END END AS action
  FROM events)"""
_SINCE = f"""WITH {_LIFE}, del AS (SELECT user_id, max({{'ts': ts, 'event_id': event_id}}) AS gone FROM life WHERE action = 'delete' GROUP BY ALL),
log AS (SELECT life.* FROM life LEFT JOIN del USING (user_id) WHERE action IN ('create', 'add', 'remove', 'note') AND (gone IS NULL OR {{'ts': ts, 'event_id': event_id}} > gone)), {_ITEMS}"""
_STATES = f"""{_LIFE}, made AS (SELECT event_id AS alert_id, user_id, hotel_id, target_price, ts AS created_at FROM life WHERE action = 'alert'),
acts AS (SELECT a.alert_id, a.ts, a.event_id, a.action FROM life a JOIN made m ON a.alert_id = m.alert_id WHERE a.action IN ('activate', 'deactivate', 'trigger', 'delete_alert') AND (a.ts > m.created_at OR a.ts = m.created_at AND a.event_id > m.alert_id)),
ended AS (SELECT alert_id, arg_max(action, {{'ts': ts, 'event_id': event_id}}) FILTER (WHERE action <> 'delete_alert') AS la, max(ts) FILTER (WHERE action = 'trigger') AS t, bool_or(action = 'delete_alert') AS gone FROM acts GROUP BY ALL),
states AS (SELECT alert_id, user_id, hotel_id, target_price, created_at, coalesce(la = 'activate', true) AS is_active, t AS triggered_at FROM made LEFT JOIN ended USING (alert_id) WHERE NOT coalesce(gone, false))"""

ORACLE_SQL = {
    "lifecycle_items": f"{_SINCE} SELECT user_id, hotel_id, x.ts AS added_at, x.price AS price_when_added FROM items",
    "lifecycle_shortlists": f"{_SINCE} SELECT user_id, created_at, coalesce(n, 0) AS items FROM (SELECT user_id, min(ts) AS created_at FROM log WHERE action IN ('create', 'add') GROUP BY ALL) LEFT JOIN (SELECT user_id, count(*) AS n FROM items GROUP BY ALL) USING (user_id)",
    "lifecycle_notes": f"{_SINCE} SELECT user_id, hotel_id, arg_max(notes, {{'ts': ts, 'event_id': event_id}}) AS notes FROM log JOIN items USING (user_id, hotel_id) WHERE action = 'note' AND ts >= x.ts GROUP BY ALL",
    "lifecycle_alerts": f"WITH {_STATES} SELECT * FROM states",
    "lifecycle_triggered": f"{_VIEWS}, {_STATES}, prices AS (SELECT hotel_id, min(price) AS min_price FROM offers GROUP BY ALL), hits AS (SELECT s.*, coalesce(is_active AND min_price <= target_price, false) AS hit FROM states s LEFT JOIN prices USING (hotel_id)) "
    "SELECT alert_id, user_id, hotel_id, target_price, created_at, is_active AND NOT hit AS is_active, CASE WHEN hit THEN TIMESTAMP '2024-06-01 00:00:00' ELSE triggered_at END AS triggered_at FROM hits",
    "parse_dates_more": "SELECT event_id, CASE event_id % 7 WHEN 6 THEN NULL WHEN 5 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS parsed FROM events",
    "same_day_pairs": "SELECT CAST(ts AS DATE) = CAST(ts + INTERVAL 6 HOUR AS DATE) AS same, count(*) AS n FROM events GROUP BY ALL",
    "prefix_numbers": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id + 0.5::DOUBLE WHEN 1 THEN -10.0::DOUBLE * event_id WHEN 3 THEN 0.25::DOUBLE END AS number FROM events",
    "criteria_key": "SELECT event_id, CAST(to_json({'airports': list_sort(['MUC', 'FRA', event_type]), 'duration': 7, 'earliest': epoch_us(ts) // 1000}) AS VARCHAR) AS key, true AS same FROM events",
    "error_severities": f"SELECT severity, coalesce(n, 0) AS n, coalesce(resolved, 0) AS resolved FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) v(severity) LEFT JOIN (SELECT CASE WHEN contains(lower(m), 'out of memory') THEN 'critical' WHEN contains(lower(m), 'corruption') OR contains(lower(m), 'deadlock') THEN 'high' WHEN contains(lower(m), 'csv') THEN 'medium' ELSE 'low' END AS severity, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS resolved FROM (SELECT *, {_MESSAGE} AS m FROM events) GROUP BY ALL) USING (severity)",
    "duplicate_hotels": "SELECT CAST(s_suppkey // 2 * 2 + s_nationkey % 2 AS BIGINT) AS id, count(*) AS n FROM supplier GROUP BY ALL HAVING count(*) > 1",
    "memory_alerts": "SELECT event_id % 100 > 85 AS alert, count(*) AS n FROM events GROUP BY ALL",
    "complex_searches": "SELECT event_id % 9 > 5 OR event_id % 5 = 0 OR event_id % 7 = 0 AS complex, count(*) AS n FROM events GROUP BY ALL",
    "array_widths": "SELECT CAST(CASE WHEN event_id * 50 <= 255 THEN 8 WHEN event_id * 50 <= 65535 THEN 16 ELSE 32 END AS INTEGER) AS bits, count(*) AS n FROM events GROUP BY ALL",
    "rows_by_position": "SELECT event_id, user_id, value FROM events WHERE event_id % 13 = 0",
    "dictionary_codes": f"{_VIEWS} SELECT room_type AS value, CAST(row_number() OVER (ORDER BY room_type) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT room_type FROM offers)",
    "bloom_generations": "SELECT i AS generation, CAST(n AS BIGINT) AS keys, CAST(m AS BIGINT) AS bits, CAST(ceil(m / n * ln(2)) AS INTEGER) AS hashes FROM (SELECT i, 1000 * power(2.0, i) AS n, ceil(-1000 * power(2.0, i) * ln(0.01 * power(0.5, i)) / (ln(2) * ln(2))) AS m FROM range(6) r(i))",
}
