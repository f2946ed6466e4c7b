"""Hand-written rows with known answers, files with dirt, streams, and plans."""

import io
import json
from contextlib import redirect_stdout
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfare.functions import codes, parsing
from wayfare.operators import indexes, mapping, search, sketches, storage
from wayfare.operators.criteria import SearchCriteria, degrade, nights
from wayfare.plans.api import Service, best_offers_json
from wayfare.sources import readers
from wayfare.streaming import streams

ROWS = [
    (1, 1200.0, 2, 0, "2024-06-01 10:00", "2024-06-08 14:00", "FRA", "All Inclusive", True, "Double Room"),
    (1, 900.0, 2, 0, "2024-06-02 08:00", "2024-06-09 12:00", "FRA", "Breakfast", False, "Single Room"),
    (2, 1500.0, 1, 1, "2024-07-10 09:00", "2024-07-17 15:00", "MUC", "Half Board", True, "Family Room"),
    (3, 2000.0, 2, 0, "2024-06-15 14:00", "2024-06-22 18:00", "FRA", "All Inclusive", True, "Suite"),
]
JUNE = SearchCriteria(("FRA",), datetime(2024, 6, 1), datetime(2024, 6, 30), 7, 2, 0)


@pytest.fixture(scope="module")
def offers(spark):
    names = "hotel_id price count_adults count_children out back outbound_departure_airport meal_type ocean_view room_type".split()
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], [*names, "l_orderkey"])
    d = d.withColumns({"outbound_departure": F.col("out").cast("timestamp_ntz"), "inbound_departure": F.col("back").cast("timestamp_ntz"), "inbound_departure_airport": F.lit("PMI")})
    return d.drop("out", "back").withColumns({"count_adults": F.col("count_adults").cast("int"), "count_children": F.col("count_children").cast("int")})


@pytest.fixture(scope="module")
def hotels(spark):
    return spark.createDataFrame([(1, "Hotel Paradise", 4.0), (2, "Beach Resort", 3.5), (3, "Luxury Suite", 5.0)], "id long, name string, stars double")


def test_cheapest_by_price(offers, hotels):
    got = search.best_offers(offers, hotels, JUNE).select("hotel_id", "min_price", "duration", "available_offers").collect()
    assert [tuple(r) for r in got] == [(1, 900.0, 7, 2), (3, 2000.0, 7, 1)]


def test_elapsed_days_differ_from_nights(offers, hotels):
    assert search.best_offers(offers, hotels, replace(JUNE, duration_mode="elapsed")).count() == 0
    assert search.best_offers(offers, hotels, replace(JUNE, duration_mode="elapsed", duration=8)).count() == 2


def test_other_airports(offers, hotels):
    assert search.best_offers(offers, hotels, replace(JUNE, departure_airports=("BCN",))).count() == 0
    july = SearchCriteria(("MUC",), datetime(2024, 7, 1), datetime(2024, 7, 31), 7, 1, 1)
    assert [r.hotel_id for r in search.best_offers(offers, hotels, july).collect()] == [2]


def test_hotel_offers_in_order(offers):
    assert [r.price for r in search.hotel_offers(offers, 1, JUNE).collect()] == [900.0, 1200.0]
    assert search.hotel_offers(offers, 999, JUNE).count() == 0
    assert [r.price for r in search.hotel_offers(offers, 1, JUNE, limit=1, offset=1).collect()] == [1200.0]


def test_invariants(offers, hotels):
    best = search.best_offers(offers, hotels, JUNE).collect()
    assert [b.min_price for b in best] == sorted(b.min_price for b in best)
    for b in best:
        detail = search.hotel_offers(offers, b.hotel_id, JUNE).collect()
        assert b.min_price == min(r.price for r in detail) and b.available_offers == len(detail)


def test_mapping(spark, hotels):
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "hotel_id long")
    two = hotels.where("id < 3")
    assert tuple(mapping.stats(ids, two).first()) == (5, 2, 3, 0.4)
    r = mapping.with_fallback(spark.createDataFrame([(999,)], "hotel_id long"), two).first()
    assert r.name == "Hotel 999" and 3 <= r.stars <= 5 and not r.is_mapped
    assert mapping.stats(ids.limit(0), two).first().match_rate == 0.0


def test_hash31(spark):
    got = spark.createDataFrame([("123",), ("",), ("zzzzzzzzzz",)], "s string").select(codes.hash31(F.col("s"))).collect()
    want = 0
    for c in "zzzzzzzzzz":
        want = (want * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert [r[0] for r in got] == [48690, 0, want]


def test_index_stats(offers):
    d = offers.withColumn("outbound_arrival_airport", F.lit("PMI")).withColumn("inbound_arrival_airport", F.col("outbound_departure_airport"))
    s = indexes.index_stats(d).first()
    assert (s.offers, s.hotels, s.airports, s.months, s.passenger_combos) == (4, 3, 3, 2, 2)
    assert indexes.by_dates(offers, datetime(2024, 6, 1), datetime(2024, 6, 30)).count() == 3
    assert indexes.by_dates(offers, datetime(2025, 1, 1), datetime(2025, 1, 31)).count() == 0


@pytest.mark.parametrize(("text", "want"), [("2024-06-01", "2024-06-01"), ("01/06/2024", "2024-06-01"), ("01-06-2024", "2024-06-01"), ("2024-06-01T12:00:00Z", "2024-06-01 12:00"), ("2024-06-01 09:30", "2024-06-01 09:30"), ("01/06/2024T12:00:00", "2024-06-01 12:00"), ("01-06-2024 12:00:00", "2024-06-01 12:00"), (" 29/02/2024 ", "2024-02-29"), ("2024-06-01T12:00:00+02:00", "2024-06-01 10:00"), ("29/02/2023", None), ("01/06-2024", None), ("01/06/2024 24:00:00", None), ("invalid", None), ("", None), ("2024-13-40", None)])
def test_dates(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(parsing.parse_date(F.col("s"))).first()[0]
    assert got == (want and datetime.fromisoformat(want))


@pytest.mark.parametrize(("a", "b", "n"), [("2024-06-01", "2024-06-08", 7), ("2024-06-01", "2024-06-01", 0), ("2024-06-30 23:00", "2024-07-01 01:00", 1), ("2024-12-30", "2025-01-06", 7), ("2024-02-28", "2024-03-01", 2), ("2024-06-08", "2024-06-01", 0)])
def test_nights(spark, a, b, n):
    d = spark.createDataFrame([(a, b)], "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("outbound_departure"), F.col("b").cast("timestamp_ntz").alias("inbound_departure"))
    assert d.select(nights()).first()[0] == n


def test_csv_files(spark, tmp_path):
    (tmp_path / "h.csv").write_text('"hotelid";"hotelname";"hotelstars"\n"1";"A; B";"4.5"\n"x";"Bad";"3"\n"3";"";"2"\n')
    h = readers.read_hotels(spark, str(tmp_path / "h.csv"))
    assert [tuple(r) for r in h.valid.collect()] == [(1, "A; B", 4.5)]
    assert tuple(h.stats.first())[:3] == (3, 1, 2)
    head = ",".join(readers.NAMED)
    good = "1,500,2,0,2024-06-01 10:00,2024-06-08 12:00,FRA,PMI,PMI,FRA,Breakfast,true,Suite"
    bad = [good.replace(",500,", ",,"), good.replace("1,", "abc,", 1), good.replace("2024-06-01 10:00", "soon")]
    (tmp_path / "o.csv").write_text("\n".join([head, good, *bad]) + "\n")
    o = readers.read_offers_named(spark, str(tmp_path / "o.csv"))
    r = o.valid.collect()
    assert len(r) == 1 and r[0].duration == 7 and r[0].ocean_view and r[0].outbound_arrival == datetime(2024, 6, 1, 12)
    assert o.rejects.count() == 3 and o.stats.first().success_rate == 0.25
    (tmp_path / "none.csv").write_text(head + "\n")
    assert tuple(readers.read_offers_named(spark, str(tmp_path / "none.csv")).stats.first()) == (0, 0, 0, 0.0)
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_offers_named(spark, str(tmp_path / "odd.csv"))
    p15 = "7,2024-06-01,2024-06-08,2,0,99.5,PMI,FRA,2024-06-08 14:00,FRA,PMI,2024-06-01 12:00,Breakfast,yes,Suite"
    (tmp_path / "p15.csv").write_text(",".join(readers.POSITIONS_15) + "\n" + p15 + "\n")
    r = readers.read_offers_pos15(spark, str(tmp_path / "p15.csv")).valid.first()
    assert (r.hotel_id, r.price, r.ocean_view, r.outbound_departure_airport, r.inbound_arrival) == (7, 99.5, True, "FRA", datetime(2024, 6, 8, 14))


def test_store_prunes_months(spark, offers, tmp_path):
    storage.write_offers(offers, str(tmp_path / "store"))
    july = SearchCriteria(earliest_departure=datetime(2024, 7, 1), latest_return=datetime(2024, 7, 31))
    d = storage.read_offers(spark, str(tmp_path / "store"), july)
    assert d.count() == 1
    out = io.StringIO()
    with redirect_stdout(out):
        d.explain()
    assert "PartitionFilters: [isnotnull(month_key" in out.getvalue()


def test_service(offers, hotels):
    s = Service(offers, hotels)
    ask = {"departureAirports": "FRA, MUC", "earliestDepartureDate": "2024-06-01", "latestReturnDate": "2024-06-30", "duration": "7", "countAdults": "2", "countChildren": "0"}
    status, d = s.best_offers(ask)
    assert status == 200 and [json.loads(r.body)["hotel"]["id"] for r in d.collect()] == [1, 3]
    assert set(json.loads(d.first().body)) == {"hotel", "minPrice", "departureDate", "returnDate", "roomType", "mealType", "countAdults", "countChildren", "duration", "countAvailableOffers"}
    assert s.best_offers({})[0] == 400 and s.hotel_offers("0", ask)[0] == 400 and s.hotel_offers("99", ask)[0] == 404
    status, d = s.hotel_offers("1", ask)
    assert status == 200 and "outbundDepartureDatetime" in json.loads(d.first().body)
    assert best_offers_json(search.best_offers(offers, hotels, replace(JUNE, duration=1))).count() == 0


def test_degrade():
    c = SearchCriteria(("A", "B", "C", "D", "E", "F"), datetime(2024, 1, 1), datetime(2024, 12, 31))
    assert degrade(c, "low") == c and len(degrade(c, "medium").departure_airports) == 5
    assert degrade(c, "critical").departure_airports == ("A",) and degrade(c, "high").latest_return == datetime(2024, 1, 31)


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(0, 500).withColumnRenamed("id", "k")
    got = sketches.membership(keys, spark.range(0, 5000).withColumnRenamed("id", "k"), "k", 1 << 14, 7).collect()
    assert all(r.maybe for r in got if r.k < 500) and sum(r.maybe for r in got if r.k >= 500) < 45


def test_exact_membership_is_sql_in(spark):
    """A filter far too small for its keys, null keys on either side, and an empty build."""
    keys, probe = spark.range(0, 500).toDF("k"), spark.range(0, 1000).toDF("k")
    null = spark.sql("SELECT CAST(NULL AS BIGINT) AS k")
    ask = lambda build, p: {r.k: r.maybe for r in sketches.exact_membership(build, p, "k", 256, 7).collect()}
    assert ask(keys, probe.union(probe).union(null)) == {**{k: k < 500 for k in range(1000)}, None: None}
    assert ask(keys.union(null), probe.union(null)) == {**{k: k < 500 or None for k in range(1000)}, None: None}
    assert ask(keys.where("k < 0"), probe.where("k < 3").union(null)) == {0: False, 1: False, 2: False, None: False}


def test_stream_ingest_equals_batch(spark, hotels, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    head = ",".join(readers.NAMED)
    for i in range(3):
        (src / f"{i}.csv").write_text("\n".join([head, *[f"{h},{100 + i},2,0,2024-0{6 + i}-01 10:00,2024-0{6 + i}-08 12:00,FRA,PMI,PMI,FRA,Breakfast,true,Suite" for h in (1, 2, 99)]]) + "\n")
    q = streams.ingest(spark, str(src), hotels, str(tmp_path / "store"), str(tmp_path / "cp"), files=1)
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "store"))
    assert sorted((r.hotel_id, r.price) for r in got.collect()) == sorted((h, 100.0 + i) for h in (1, 2) for i in range(3))


def test_stream_slow_requests(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    rows = [(t + timedelta(seconds=i), "a", 2000.0) for i in range(6)] + [(t, "b", 2000.0), (t + timedelta(hours=1), "a", 5.0), (t + timedelta(hours=2), "a", 2000.0)]
    spark.createDataFrame(rows, "ts timestamp, endpoint string, duration_ms double").write.parquet(str(tmp_path / "r"))
    q = streams.slow_requests(spark.readStream.schema("ts timestamp, endpoint string, duration_ms double").parquet(str(tmp_path / "r"))).writeStream.format("memory").queryName("slow").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM slow").collect()
    assert got and {r.endpoint for r in got} == {"a"} and max(r.slow_count for r in got) == 6


def test_bitset_counts_any_id(spark):
    """Every id counts, also negative, very large and null ones."""
    ids = [-(2**62), -40_000, -32_768, -1, 0, 1, 32_768, 32_769, 32_000_000, 32_000_001, 2**40, 2**62, None]
    rows = [(i, "FRA", 50.0, "x") for i in ids for _ in range(2)] + [(i, "x", 3000.0, "Breakfast") for i in [*ids[3:], 7, -9]]
    d = spark.createDataFrame(rows, "hotel_id long, outbound_departure_airport string, price double, meal_type string")
    assert tuple(indexes.bitset_counts(d).first()) == (13, 12, 10, 15)
