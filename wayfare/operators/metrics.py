"""Request, search, cache and error metrics, and the rules of operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.operators.ranking import quantiles

#: Limits, categories and, below, the words and shares of the rules.
SLOW_MS, ALERT_COUNT, ALERT_US = 1000.0, 5, 60_000_000
SEVERITIES, MEMORY_ALERT = ("low", "medium", "high", "critical"), 85
CATEGORIES = ("memory", "io", "network", "validation", "data_processing", "unknown")


def _slow() -> Column:
    return F.col("duration_ms") > SLOW_MS


def request_summary(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").alias("total"), F.avg("duration_ms").alias("avg_ms"), F.avg(F.when(_slow(), 100.0).otherwise(0.0)).alias("slow_percent"))


def request_by_endpoint(d: DataFrame) -> DataFrame:
    return d.groupBy("endpoint").agg(
        F.count("*").alias("total"), F.avg("duration_ms").alias("avg_ms"), F.max("duration_ms").alias("max_ms"), F.min("duration_ms").alias("min_ms"), F.avg(F.when(_slow(), 100.0).otherwise(0.0)).alias("slow_percent")
    )


def level_of(ms: Column) -> Column:
    return F.when(ms > 5000, F.lit("error")).when(ms > SLOW_MS, F.lit("warn")).otherwise(F.lit("info"))


def request_levels(d: DataFrame) -> DataFrame:
    return d.groupBy(level_of(F.col("duration_ms")).alias("level")).agg(F.count("*").alias("n"))


def recent_slow(d: DataFrame, keep: int = 1000, show: int = 20) -> DataFrame:
    """The last ``show`` slow requests among the last ``keep``: two top-k steps, no global sort."""
    last = d.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)
    return last.where(_slow()).orderBy(F.desc("ts"), F.desc("event_id")).limit(show).select("event_id", "endpoint", "duration_ms", "ts")


def sustained_slow(d: DataFrame, micros: Column) -> DataFrame:
    """Slow requests with ALERT_COUNT or more slow ones of their endpoint in the trailing minute, which excludes its far end."""
    d = d.where(_slow()).select("event_id", "endpoint", micros.alias("t")).withColumn("own", F.expr(f"t div {ALERT_US}"))
    # windows hold a minute of an endpoint and the minute before, which each row is copied from into the next
    d = d.withColumn("minute", F.explode(F.array("own", F.col("own") + 1)))
    w = Window.partitionBy("endpoint", "minute").orderBy("t").rangeBetween(-(ALERT_US - 1), 0)
    return d.withColumn("slow_count", F.count("*").over(w)).where((F.col("minute") == F.col("own")) & (F.col("slow_count") >= ALERT_COUNT)).select("event_id", "endpoint", "t", "slow_count")


def search_stats(d: DataFrame, last: int = 10) -> DataFrame:
    """By search type: count, average, slow count, and the average of its last searches."""
    recent = d.withColumn("rn", F.row_number().over(Window.partitionBy("endpoint").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("rn") <= last).groupBy("endpoint").agg(F.avg("duration_ms").alias("recent_avg_ms"))
    return d.groupBy("endpoint").agg(F.count("*").alias("total"), F.avg("duration_ms").alias("avg_ms"), F.count_if(_slow()).alias("slow")).join(recent, "endpoint")


def cache_hit_rate(d: DataFrame, hit: Column) -> DataFrame:
    return d.agg(F.count("*").alias("total"), F.avg("duration_ms").alias("avg_ms"), F.avg(F.when(hit, 100.0).otherwise(0.0)).alias("hit_percent"))


def percentiles(d: DataFrame, points=(0.5, 0.95, 0.99)) -> DataFrame:
    """(p, value): nearest-rank percentiles, by counts of values."""
    return quantiles(d, "duration_ms", points)


def _has(m: Column, *words: str) -> Column:
    out = m.contains(words[0])
    for w in words[1:]:
        out = out | m.contains(w)
    return out


def error_category(message: Column) -> Column:
    """By the first group of words that the lower-cased message holds."""
    m = F.lower(message)
    return (
        F.when(_has(m, "memory", "heap"), "memory").when(_has(m, "file", "enoent", "eacces"), "io").when(_has(m, "network", "timeout", "connection"), "network")
        .when(_has(m, "validation", "invalid", "parse"), "validation").when(_has(m, "csv", "data", "processing"), "data_processing").otherwise("unknown")
    )


def error_severity(message: Column, category: Column) -> Column:
    m = F.lower(message)
    return F.when(_has(m, "out of memory", "fatal", "segmentation fault"), "critical").when((category == "system") | _has(m, "corruption", "deadlock"), "high").when(category.isin("data_processing", "memory"), "medium").otherwise("low")


def error_http(name: Column, message: Column) -> Column:
    """The HTTP status of an error."""
    return (
        F.when(name == "ValidationError", 400).when((name == "TypeError") & message.contains("Cannot read property"), 400).when(message.contains("timeout"), 504)
        .when(_has(message, "ENOENT", "file not found"), 503).when(_has(message, "ENOMEM", "out of memory"), 503).when(_has(message, "ECONNREFUSED", "network"), 503).otherwise(500)
    )


def error_stats(spark, errors: DataFrame, operations: int | Column) -> DataFrame:
    """(category, n, resolved, error_rate, alert) of ``errors(message, resolved)``, every category present."""
    c = errors.groupBy(error_category(F.col("message")).alias("category")).agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"))
    names = spark.createDataFrame([(x,) for x in CATEGORIES], "category string")
    ops = F.lit(operations) if isinstance(operations, int) else operations
    zero = F.lit(0).cast("long")
    d = names.join(c, "category", "left").select("category", F.coalesce("n", zero).alias("n"), F.coalesce("resolved", zero).alias("resolved"))
    return d.withColumn("error_rate", F.when(ops > 0, F.col("n") / ops).otherwise(0.0)).withColumn("alert", F.col("error_rate") > 0.05)


def error_severity_stats(errors: DataFrame) -> DataFrame:
    """(severity, n, resolved) of ``errors(message, resolved)``, every severity present."""
    c = errors.withColumn("category", error_category(F.col("message"))).groupBy(error_severity(F.col("message"), F.col("category")).alias("severity")).agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"))
    names = errors.sparkSession.createDataFrame([(x,) for x in SEVERITIES], "severity string")
    zero = F.lit(0).cast("long")
    return names.join(c, "severity", "left").select("severity", F.coalesce("n", zero).alias("n"), F.coalesce("resolved", zero).alias("resolved"))


def memory_alert(used_percent: Column) -> Column:
    """The alert rule of memory."""
    return used_percent > MEMORY_ALERT


def operation_stats(d: DataFrame) -> DataFrame:
    """One row of ``d(records, duration_ms, success)``; the success rate of none is 1."""
    return d.agg(
        F.coalesce(F.avg(F.col("records") / F.col("duration_ms") * 1000.0), F.lit(0.0)).alias("avg_throughput"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)), F.lit(1.0)).alias("success_rate"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"),
    )


def backoff_ms(attempt: Column, base: int = 1000, most: int = 30_000) -> Column:
    return F.least(F.lit(most).cast("double"), base * F.pow(F.lit(2.0), attempt)).cast("long")


def pressure_level(heap: Column, system: Column) -> Column:
    """From the percentages of heap and system memory in use."""
    return F.when((heap >= 90) | (system >= 95), "critical").when((heap >= 80) | (system >= 85), "high").when((heap >= 70) | (system >= 75), "medium").otherwise("low")


def complexity(airports: Column, dates: Column, passengers: Column, duration: Column) -> Column:
    """How many parts of the criteria are given."""
    return (airports > 1).cast("int") + dates.cast("int") + passengers.cast("int") + duration.cast("int")


def complex_criteria(airports: Column, earliest: Column, latest: Column) -> Column:
    """The second rule: more than five airports, or a date that is not given."""
    return (airports > 5) | earliest.isNull() | latest.isNull()


def search_strategy(offers: Column, pressure: Column, hint: Column, score: Column) -> Column:
    big = (offers > 50_000_000) | pressure.isin("critical", "high") | hint.isin("massive", "large") | (offers > 10_000_000)
    return F.when(big, "streaming").when((score >= 2) & (pressure == "low"), "parallel").otherwise("sequential")


def size_class(offers: Column) -> Column:
    return F.when(offers < 100_000, "small").when(offers < 1_000_000, "medium").when(offers < 10_000_000, "large").otherwise("massive")


def adaptive_config(offers: Column, cores: Column, high: Column) -> dict[str, Column]:
    """Workers, chunk size and streaming threshold by size of the data, cores and whether queries are complex."""
    s = size_class(offers)
    pick = lambda *v: F.when(s == "small", v[0]).when(s == "medium", v[1]).when(s == "large", v[2]).otherwise(v[3])
    chunk = pick(5000, 10000, 20000, 50000)
    return {"size_class": s, "workers": pick(F.lit(1), F.least(F.lit(2), cores), F.least(F.lit(4), cores), cores), "chunk_size": F.when(high, F.floor(chunk * F.lit(7) / F.lit(10)).cast("int")).otherwise(chunk), "streaming_threshold": pick(5000, 2000, 1000, 500)}


def cache_evictions(d: DataFrame, now: Column, ttl_ms: int = 300_000, share: float = 0.1) -> DataFrame:
    """(event_id, reason): entries older than the time to live, else the oldest tenth. ``d(event_id, ts)``; now in microseconds."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = d.select("event_id", us.alias("us"))
    cut = quantiles(d, "us", (share,)).select(F.col("value").alias("cut"))
    return d.join(F.broadcast(cut)).select("event_id", F.when(now - F.col("us") > ttl_ms * 1000, "expired").when(F.col("us") <= F.col("cut"), "oldest").alias("reason")).where("reason IS NOT NULL")
