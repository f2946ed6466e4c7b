"""Shortlists and price alerts as the latest state of a mutation log.

The log has (event_id, ts, user_id, hotel_id, action, price, target_price, notes); (ts, event_id) orders it. Every state is
one aggregation by its key, so a log of any length reduces in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def _at() -> Column:
    return F.struct("ts", "event_id")


def _is(*actions: str) -> Column:
    return F.col("action").isin(*actions)


def user_shortlists(log: DataFrame) -> DataFrame:
    """(user_id, created_at, items): each user's shortlist, since its creation or first item, with the items present."""
    made = log.where(_is("create", "add")).groupBy("user_id").agg(F.min("ts").alias("created_at"))
    items = shortlist_items(log).groupBy("user_id").agg(F.count("*").alias("items"))
    return made.join(items, "user_id", "left").select("user_id", "created_at", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


def shortlist_items(log: DataFrame) -> DataFrame:
    """(user_id, hotel_id, added_at, price_when_added): present if the last action adds; of adds since the last remove the first counts."""
    d = log.where(_is("add", "remove"))
    removed = d.where(_is("remove")).groupBy("user_id", "hotel_id").agg(F.max(_at()).alias("removed"))
    added = d.where(_is("add")).join(removed, ["user_id", "hotel_id"], "left").where(F.col("removed").isNull() | (_at() > F.col("removed")))
    first = added.groupBy("user_id", "hotel_id").agg(F.min(F.struct("ts", "event_id", "price")).alias("x"))
    return first.select("user_id", "hotel_id", F.col("x.ts").alias("added_at"), F.col("x.price").alias("price_when_added"))


def shortlist_notes(log: DataFrame) -> DataFrame:
    """(user_id, hotel_id, notes): the last notes of each key."""
    return log.where(_is("note")).groupBy("user_id", "hotel_id").agg(F.max(F.struct("ts", "event_id", "notes")).alias("x")).select("user_id", "hotel_id", "x.notes")


def is_shortlisted(items: DataFrame, user_id: int) -> DataFrame:
    """One row: whether the user has any item."""
    return items.where(F.col("user_id") == user_id).agg((F.count("*") > 0).alias("liked"))


def price_alerts(log: DataFrame, active_only: bool = False) -> DataFrame:
    """(alert_id, user_id, hotel_id, target_price, created_at, is_active): an alert ends when its item is removed later."""
    removed = log.where(_is("remove")).groupBy("user_id", "hotel_id").agg(F.max(_at()).alias("removed"))
    d = log.where(_is("alert")).join(removed, ["user_id", "hotel_id"], "left")
    active = F.col("removed").isNull() | (_at() > F.col("removed"))
    d = d.select(F.col("event_id").alias("alert_id"), "user_id", "hotel_id", "target_price", F.col("ts").alias("created_at"), active.alias("is_active"))
    return d.where("is_active") if active_only else d


def triggered(alerts: DataFrame, prices: DataFrame) -> DataFrame:
    """Active alerts whose hotel's least price, in ``prices(hotel_id, min_price)``, is at or under the target."""
    d = alerts.where("is_active").join(prices, "hotel_id").where("min_price <= target_price")
    return d.select("alert_id", "user_id", "hotel_id", "target_price", "min_price")


def since_deletion(log: DataFrame) -> DataFrame:
    """The actions on shortlists that count: of a user who deleted the shortlist, those after the last deletion."""
    deleted = log.where(_is("delete")).groupBy("user_id").agg(F.max(_at()).alias("deleted"))
    d = log.where(_is("create", "add", "remove", "note")).join(deleted, "user_id", "left")
    return d.where(F.col("deleted").isNull() | (_at() > F.col("deleted"))).drop("deleted")


def item_notes(log: DataFrame) -> DataFrame:
    """(user_id, hotel_id, notes) of items present: the last notes since the item was added."""
    items = shortlist_items(log)
    notes = log.where(_is("note")).join(items, ["user_id", "hotel_id"]).where(F.col("ts") >= F.col("added_at"))
    return notes.groupBy("user_id", "hotel_id").agg(F.max(F.struct("ts", "event_id", "notes")).alias("x")).select("user_id", "hotel_id", "x.notes")


def alert_states(log: DataFrame) -> DataFrame:
    """(alert_id, user_id, hotel_id, target_price, created_at, is_active, triggered_at) of alerts that are not deleted.

    The log's rows name the alert they act on in ``alert_id``: "activate", "deactivate", "trigger" and "delete_alert" after
    its creation; the last of the first three says whether it is active, a trigger ends it and leaves its time.
    """
    acts = log.where(_is("activate", "deactivate", "trigger", "delete_alert")).select("alert_id", _at().alias("at"), "action")
    made = log.where(_is("alert")).select("event_id", "ts", "user_id", "hotel_id", "target_price", _at().alias("made"))
    acts = acts.join(made.select(F.col("event_id").alias("alert_id"), "made"), "alert_id").where("at > made")
    last = acts.groupBy("alert_id").agg(
        F.max(F.when(F.col("action") != "delete_alert", F.struct("at", "action"))).alias("last"), F.max(F.when(F.col("action") == "trigger", F.col("at"))).alias("t"), F.bool_or(F.col("action") == "delete_alert").alias("gone")
    )
    d = made.withColumnRenamed("event_id", "alert_id").join(last, "alert_id", "left").where(~F.coalesce("gone", F.lit(False)))
    active = F.coalesce(F.col("last.action") == "activate", F.lit(True))
    return d.select("alert_id", "user_id", "hotel_id", "target_price", F.col("ts").alias("created_at"), active.alias("is_active"), F.col("t.ts").alias("triggered_at"))


def trigger(alerts: DataFrame, prices: DataFrame, now: Column) -> DataFrame:
    """alerts after a look at ``prices(hotel_id, min_price)``: active ones at or over the least price are inactive and have the time."""
    d = alerts.join(prices, "hotel_id", "left")
    hit = F.coalesce(F.col("is_active") & (F.col("min_price") <= F.col("target_price")), F.lit(False))
    return d.withColumns({"triggered_at": F.when(hit, now).otherwise(F.col("triggered_at")), "is_active": F.col("is_active") & ~hit}).select(*alerts.columns)


def export_state(log: DataFrame, path: str) -> None:
    """The present shortlist items and alerts as JSON, in folders of the path."""
    shortlist_items(since_deletion(log)).write.mode("overwrite").json(f"{path}/items")
    alert_states(log).write.mode("overwrite").json(f"{path}/alerts")


def import_state(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, alerts) as export_state() wrote them; they replace what there is."""
    items = spark.read.schema("user_id long, hotel_id long, added_at timestamp_ntz, price_when_added double").json(f"{path}/items")
    alerts = "alert_id long, user_id long, hotel_id long, target_price double, created_at timestamp_ntz, is_active boolean, triggered_at timestamp_ntz"
    return items, spark.read.schema(alerts).json(f"{path}/alerts")


def stats(log: DataFrame) -> DataFrame:
    """One row: shortlists, items, users with alerts, alerts, active alerts."""
    lists, items, alerts = user_shortlists(log).agg(F.count("*").alias("shortlists")), shortlist_items(log).agg(F.count("*").alias("items")), price_alerts(log)
    a = alerts.agg(F.countDistinct("user_id").alias("alert_users"), F.count("*").alias("alerts"), F.count_if("is_active").alias("active_alerts"))
    return lists.join(F.broadcast(items)).join(F.broadcast(a))  # one row each
