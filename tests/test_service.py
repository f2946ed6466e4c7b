"""Routes of the service, the life of its state, order statistics and plans at scale."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare.operators import indexes, metrics, ranking, search, storage, userstate
from wayfare.operators.cache import ResultCache
from wayfare.plans import catalog
from wayfare.plans.api import Service
from wayfare.sources import readers
from wayfare.sources.fixtures import hotels, life_log, offers, request_log
from wayfare.streaming.streams import Progress, ingest

SF = "/root/testdata/sf0.001"
PARAMS = {"departureAirports": "FRA,MUC", "earliestDepartureDate": "1996-01-01", "latestReturnDate": "2001-12-31", "duration": "7", "countAdults": "2", "countChildren": "0"}
T = datetime(2030, 1, 1)


@pytest.fixture(scope="module")
def service(spark):
    return Service(offers(spark, SF), hotels(spark, SF), life_log(spark, SF), requests=request_log(spark, SF))


def test_routes(service):
    status, best = service.best_offers(PARAMS)
    assert status == 200 and best.count() > 0
    service.best_offers(dict(reversed(PARAMS.items())))
    assert service.cache_stats()["hits"] == 1 and service.cache_stats()["entries"] == 1
    service.clear_cache()
    assert service.cache_stats()["entries"] == 0
    assert service.best_offers({**PARAMS, "duration": "x"})[0] == 400 and service.hotel_offers("0", PARAMS)[0] == 400 and service.hotel_offers("999999", PARAMS)[0] == 404
    c = catalog.WIDE
    assert service.similar(5, c).count() > 0 and service.trending(c).count() > 0 and service.value_deals(c).count() > 0 and service.recommendations(1, c).count() > 0
    assert [r.value for r in service.airports().collect()] == ["BER", "CGN", "DUS", "FRA", "HAM", "MUC"] and service.meal_types().count() == 3 and service.room_types().count() == 4
    assert service.health()["healthy"] and service.status().first().offers == service.offers.count() and service.metrics().count() > 0 and service.mapping().count() == 1


def test_life_of_shortlists_and_alerts(service):
    s = service.create_shortlist(10**6, T, 999).add_item(10**6 + 1, T, 999, 5, 120.0).add_item(10**6 + 2, T, 999, 6, 80.0)
    assert {r.hotel_id for r in s.shortlist_items(999).collect()} == {5, 6}
    s = s.remove_item(10**6 + 3, T, 999, 5)
    assert [r["items"] for r in s.user_shortlists(999).collect()] == [1]
    gone = s.delete_shortlist(10**6 + 4, T, 999)
    assert gone.user_shortlists(999).count() == 0 and gone.shortlist_items(999).count() == 0
    assert gone.add_item(10**6 + 5, T + timedelta(1), 999, 7, 1.0).shortlist_items(999).first().hotel_id == 7
    assert s.create_alert(0, T, 999, 5, -1.0)[0] == 400
    status, s = s.create_alert(10**6 + 6, T, 999, 5, 1e9)
    assert status == 201
    of = lambda x: [(r.alert_id, r.is_active, r.triggered_at) for r in x.user_alerts(999).collect()]
    assert of(s) == [(10**6 + 6, True, None)]
    off = s.update_alert(10**6 + 7, T, 10**6 + 6, False)[1]
    assert of(off) == [(10**6 + 6, False, None)] and of(off.update_alert(10**6 + 8, T, 10**6 + 6, True)[1]) == of(s)
    fired = s.act(10**6 + 9, T, "trigger", alert_id=10**6 + 6)
    assert of(fired) == [(10**6 + 6, False, T)]
    assert of(s.delete_alert(10**6 + 9, T, 10**6 + 6)[1]) == [] and s.delete_alert(0, T, 12345678)[0] == 404
    prices = s.offers.groupBy("hotel_id").agg(F.min("price").alias("min_price"))
    after = userstate.trigger(userstate.alert_states(s.log), prices, F.lit(T).cast("timestamp_ntz")).where("user_id = 999").first()
    assert (after.is_active, after.triggered_at) == (False, T)


def test_export_and_import(service, spark, tmp_path):
    userstate.export_state(service.log, str(tmp_path))
    items, alerts = userstate.import_state(spark, str(tmp_path))
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(items.select("user_id", "hotel_id")) == key(userstate.shortlist_items(userstate.since_deletion(service.log)).select("user_id", "hotel_id"))
    assert key(alerts.drop("created_at", "triggered_at")) == key(userstate.alert_states(service.log).drop("created_at", "triggered_at"))


def test_cache():
    class Held:
        def persist(self):
            return self

        def unpersist(self):
            dropped.append(self)

    now, dropped = [0.0], []
    c = ResultCache(ttl=10, capacity=20, clock=lambda: now[0])
    for i in range(20):
        c.get(str(i), Held)
    c.get("3", Held)
    assert c.hits == 1 and not dropped
    c.get("20", Held)
    assert len(dropped) == 2 and c.evicted == 2 and len(c.entries) == 19 and "0" not in c.entries
    now[0] = 11
    c.get("5", Held)
    assert c.misses == 22 and c.sweep() == 18 and c.stats()["entries"] == 1


def test_quantiles_and_ranks(spark):
    d = spark.createDataFrame([(float(x),) for x in [*range(1000), 5, 5, 5, 10**9]] + [(None,)], "v double")
    got = {r.p: r.value for r in ranking.quantiles(d, "v", (0.1, 0.5, 0.99, 1.0)).collect()}
    want = d.agg(*[F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY v)").alias(str(p)) for p in got]).first().asDict()
    assert {str(k): v for k, v in got.items()} == want
    assert ranking.quantiles(d.where("false"), "v", (0.5,)).collect() == []
    assert {r.p: r.value for r in ranking.quantiles(d.where("v = 7"), "v", (0.5,)).collect()} == {0.5: 7.0}
    r = ranking.numbered(d, "v", ["v"]).orderBy("rank").collect()
    assert [x["rank"] for x in r] == list(range(1005)) and [x.v for x in r] == [None, *sorted(x.v for x in r if x.v is not None)]
    words = spark.createDataFrame([(w,) for w in ("", "b", "ba", "é", "aé", "a", "zz", "Z")], "value string")
    codes = {r.value: r.code for r in storage.dictionary(words, "value").collect()}
    assert codes == {w: i for i, w in enumerate(sorted(codes, key=lambda w: w.encode()))}


def test_single_tasks_hold_buckets_only(spark):
    """Where a plan has an exchange to one task, an aggregation by bucket stands before it, never rows."""
    for name in ("best_offers_chunks", "latency_percentiles", "cache_evictions", "sustained_slow_alerts", "index_stats"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert any("Aggregate" in below for below in lines[i + 1 : i + 4]), (name, plan)


def test_slow_minutes_cross_their_borders(spark):
    us = 1_000_000
    rows = [(i, "a", 2000.0, 59 * us + i * us) for i in range(5)] + [(9, "a", 2000.0, 119 * us), (10, "b", 2000.0, 60 * us)]
    got = metrics.sustained_slow(spark.createDataFrame(rows, "event_id int, endpoint string, duration_ms double, at long"), F.col("at")).collect()
    assert {(r.event_id, r.slow_count) for r in got} == {(4, 5), (9, 5)}


def test_intersection_is_a_filter(spark):
    o = offers(spark, SF)
    want = indexes.intersect(indexes.by_airports(o, ("FRA",)), indexes.by_dates(o, catalog.EARLIEST, catalog.LATEST), indexes.by_passengers(o, 2, 0))
    key = lambda d: sorted(map(tuple, d.select(*catalog.KEYS).collect()))
    got = indexes.index_intersection(o, ("FRA",), catalog.EARLIEST, catalog.LATEST, 2, 0)
    assert key(got) == key(want) and "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_positional_lines(spark):
    line = '7,2024-05-01 10:00,2024-05-08 09:00:00,2,0,199.5,PMI,FRA,,"FRA",PMI,2024-05-01 13:30:00,"Half, Board",yes,Suite'
    d = spark.createDataFrame([(line,), ("7,short",)], "line string")
    got = readers.parse_pos15(d)
    r = got.valid.first()
    assert (r.hotel_id, r.price, r.meal_type, r.ocean_view, r.outbound_arrival, r.inbound_arrival) == (7, 199.5, "Half, Board", True, datetime(2024, 5, 1, 13, 30), datetime(2024, 5, 8, 11)) and got.rejects.count() == 1
    line = "8;2024-05-01;2024-05-08;2;1;100;FRA;PMI;PMI;FRA;Breakfast;Suite;9;false"
    r = readers.parse_pos14(spark.createDataFrame([(line,)], "line string")).valid.first()
    assert (r.hotel_id, r.duration, r.ocean_view, r.outbound_departure_airport) == (8, 9, False, "FRA")


def test_stream_keeps_rejects_and_tells_progress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    head = ",".join(readers.NAMED)
    good = "2,100,2,0,2024-05-01,2024-05-08,FRA,PMI,PMI,FRA,Breakfast,true,Suite"
    (tmp_path / "in" / "a.csv").write_text(f"{head}\n{good}\nx{good}\n")
    told, progress = [], None
    progress = Progress(told.append)
    spark.streams.addListener(progress)
    q = ingest(spark, str(tmp_path / "in"), hotels(spark, SF), str(tmp_path / "store"), str(tmp_path / "cp"), rejects=str(tmp_path / "bad"))
    q.awaitTermination()
    for _ in range(100):
        if progress.ended:
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 1 and spark.read.parquet(str(tmp_path / "bad/rows")).first().raw_hotelid == "x2"
    assert tuple(spark.read.parquet(str(tmp_path / "bad/counts")).select("total", "valid", "errors").first()) == (2, 1, 1)
    assert progress.rows >= 2 and told


def test_store_grows_with_the_input(spark, tmp_path):
    o = offers(spark, SF)
    storage.write_offers(o, str(tmp_path / "store"))
    assert storage.read_offers(spark, str(tmp_path / "store")).count() == o.count()
    assert search.chunks(catalog.best(spark, SF), 10).agg(F.max("chunk")).first()[0] >= 0
