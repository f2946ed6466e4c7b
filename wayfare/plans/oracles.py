"""For each query the SQL that gives the same rows on the driver's tables."""

from __future__ import annotations

_VIEWS = """WITH hotels AS (
  SELECT CAST(s_suppkey + 1 AS BIGINT) AS id, s_name AS name, CAST(1.0 + (s_suppkey % 9) * 0.5 AS DOUBLE) AS stars FROM supplier WHERE s_suppkey % 10 <> 7),
offers0 AS (
  SELECT CAST(l_suppkey + 1 AS BIGINT) AS hotel_id, CAST(l_extendedprice / 50.0 AS DOUBLE) AS price, CAST(1 + l_linenumber % 4 AS INTEGER) AS count_adults,
    CAST(CAST(trunc(l_quantity) AS INTEGER) % 3 AS INTEGER) AS count_children, l_shipdate + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS outbound_departure,
    l_shipdate + to_days(CAST(1 + l_orderkey % 14 AS INTEGER)) + to_hours(CAST(trunc(l_quantity) AS INTEGER) % 24) AS inbound_departure,
    CASE l_partkey % 6 WHEN 0 THEN 'FRA' WHEN 1 THEN 'MUC' WHEN 2 THEN 'DUS' WHEN 3 THEN 'HAM' WHEN 4 THEN 'BER' ELSE 'CGN' END AS outbound_departure_airport,
    CASE l_returnflag WHEN 'A' THEN 'All Inclusive' WHEN 'N' THEN 'Half Board' ELSE 'Breakfast' END AS meal_type, l_linestatus = 'F' AS ocean_view,
    CASE l_linenumber % 4 WHEN 0 THEN 'Suite' WHEN 1 THEN 'Double Room' WHEN 2 THEN 'Ocean View Room' ELSE 'Family Room' END AS room_type, l_orderkey, l_partkey, l_linenumber, l_quantity
  FROM lineitem),
offers AS (
  SELECT *, outbound_departure + to_hours(2) AS outbound_arrival, inbound_departure + to_hours(2) AS inbound_arrival,
    CASE WHEN l_linenumber = 7 THEN outbound_departure_airport ELSE 'PMI' END AS inbound_departure_airport, CASE WHEN l_linenumber = 7 THEN outbound_departure_airport ELSE 'PMI' END AS outbound_arrival_airport,
    outbound_departure_airport AS inbound_arrival_airport, CAST(greatest(0, date_diff('day', CAST(outbound_departure AS DATE), CAST(inbound_departure AS DATE))) AS INTEGER) AS duration,
    CAST(ceil(date_diff('millisecond', outbound_departure, inbound_departure) / 86400000.0) AS INTEGER) AS elapsed
  FROM offers0),
log AS (
  SELECT event_id, ts, user_id, CAST(1 + event_id % 100 AS BIGINT) AS hotel_id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'note' WHEN 'purchase' THEN 'alert' END AS action,
    value * 4 AS price, 500 + value AS target_price, props AS notes FROM events),
requests AS (SELECT event_id, ts, event_type AS endpoint, value * 20 AS duration_ms, user_id FROM events)"""

_ORDER = "price, outbound_departure, inbound_departure, outbound_departure_airport, room_type, meal_type, ocean_view, l_orderkey, l_partkey, l_linenumber"
_SHOWN = "hotel_id, name AS hotel_name, stars AS hotel_stars, price AS min_price, outbound_departure AS departure_date, inbound_departure AS return_date, room_type, meal_type, count_adults, count_children, duration, available_offers"
_KEYS = "hotel_id, price, l_orderkey, l_partkey, l_linenumber"
_DATED = "outbound_departure >= TIMESTAMP '1996-01-01' AND inbound_departure <= TIMESTAMP '2001-12-31' AND count_adults = 2 AND count_children = 0"
_STANDARD = f"outbound_departure_airport IN ('FRA', 'MUC') AND {_DATED} AND duration = 7"
_WIDE = "outbound_departure >= TIMESTAMP '1995-01-01' AND inbound_departure <= TIMESTAMP '2002-12-31' AND count_adults = 2"


def _best(where: str, join: str = "JOIN", shown: str = _SHOWN) -> str:
    return (
        f"SELECT {shown} FROM (SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY {_ORDER}) AS rn, count(*) OVER (PARTITION BY hotel_id) AS available_offers FROM offers WHERE {where}) o "
        f"{join} hotels ON id = hotel_id WHERE rn = 1"
    )


_FILTERS = {
    "filter_passengers": "count_adults = 2 AND count_children = 0",
    "filter_duration_nights": "duration = 7",
    "filter_duration_elapsed": "elapsed = 7",
    "filter_airports": "outbound_departure_airport IN ('FRA', 'MUC')",
    "filter_dates": "outbound_departure >= TIMESTAMP '1996-01-01' AND inbound_departure <= TIMESTAMP '1996-12-31'",
    "filter_meal_room": "meal_type IN ('All Inclusive', 'Half Board') AND room_type = 'Suite'",
    "filter_ocean_view": "ocean_view",
    "filter_price_range": "price BETWEEN 100 AND 500",
    "filter_hotel_stars": "hotel_id IN (SELECT id FROM hotels WHERE stars IN (4.0, 4.5))",
    "filter_hotel_ids": "hotel_id IN (1, 2, 3)",
    "filter_all": (
        "outbound_departure_airport IN ('FRA', 'MUC') AND outbound_departure >= TIMESTAMP '1995-01-01' AND inbound_departure <= TIMESTAMP '2001-12-31' AND count_adults = 2 AND count_children = 0 AND duration = 7 "
        "AND meal_type IN ('All Inclusive', 'Half Board') AND room_type IN ('Double Room', 'Suite') AND price BETWEEN 50 AND 1500 AND hotel_id IN (SELECT id FROM hotels WHERE stars IN (1, 2, 3, 4, 5))"
    ),
}
_MONTH = "strftime(outbound_departure, '%Y-%m')"
_CANDIDATES_DATE = "outbound_departure >= TIMESTAMP '1996-03-01' AND outbound_departure < TIMESTAMP '1996-07-01'"
_DATETEXT = "CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%d/%m/%Y') WHEN 2 THEN strftime(ts, '%d-%m-%Y') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'invalid' END"
_REMOVED = "removed AS (SELECT user_id, hotel_id, max({'ts': ts, 'event_id': event_id}) AS r FROM log WHERE action = 'remove' GROUP BY ALL)"
_ITEMS = (
    f"{_REMOVED}, items AS (SELECT user_id, hotel_id, min({{'ts': ts, 'event_id': event_id, 'price': price}}) AS x FROM log LEFT JOIN removed USING (user_id, hotel_id) "
    "WHERE action = 'add' AND (r IS NULL OR {'ts': ts, 'event_id': event_id} > r) GROUP BY ALL)"
)
_ALERTS = f"{_REMOVED}, alerts AS (SELECT event_id AS alert_id, user_id, hotel_id, target_price, ts AS created_at, r IS NULL OR {{'ts': ts, 'event_id': event_id}} > r AS is_active FROM log LEFT JOIN removed USING (user_id, hotel_id) WHERE action = 'alert')"
_SLOW = "avg(CASE WHEN duration_ms > 1000 THEN 100.0 ELSE 0.0 END)::DOUBLE"
_MESSAGE = "CASE event_id % 8 WHEN 0 THEN 'Out of memory' WHEN 1 THEN 'ENOENT: file not found' WHEN 2 THEN 'network timeout' WHEN 3 THEN 'invalid input' WHEN 4 THEN 'csv corruption' WHEN 5 THEN 'Cannot read property x' WHEN 6 THEN 'ECONNREFUSED' ELSE 'deadlock' END"
_CATEGORY = "CASE event_id % 8 WHEN 0 THEN 'memory' WHEN 1 THEN 'io' WHEN 2 THEN 'network' WHEN 3 THEN 'validation' WHEN 4 THEN 'data_processing' ELSE 'unknown' END"


def _raw(extra: str = "") -> str:
    """Offers that survive parsing: the day-only format has lost the time of day, the one with minutes the seconds."""
    cut = lambda c: f"CASE WHEN l_orderkey % 3 = 2 THEN CAST(CAST({c} AS DATE) AS TIMESTAMP) WHEN l_orderkey % 3 = 0 THEN date_trunc('minute', {c}) ELSE {c} END"
    return (
        f"SELECT hotel_id, CAST(floor(price) AS DOUBLE) AS price, {cut('outbound_departure')} AS outbound_departure, {cut('inbound_departure')} AS inbound_departure, {extra} "
        "FROM offers WHERE l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AND l_partkey % 23 <> 0"
    )


def _parsed(extra: str) -> str:
    return f"SELECT *, count(*) AS n FROM ({_raw(extra)}) GROUP BY ALL"


def _top(score: str, reasons: str, k: int, where: str = "true") -> str:
    return (
        f", best AS ({_best(_WIDE)}) SELECT hotel_id, hotel_name, hotel_stars, min_price, floor(({score}) * 10 + 0.5) / 10.0 AS score, array_to_string(list_filter([{reasons}], lambda x: x IS NOT NULL), '; ') AS reasons "
        f"FROM best WHERE {where} ORDER BY score DESC, min_price, hotel_id LIMIT {k}"
    )


_POINTS = "CASE WHEN {} THEN {} ELSE 0.0 END"
_FULL, _SEA = "meal_type = 'All Inclusive'", "contains(lower(room_type), 'ocean') OR contains(lower(room_type), 'sea')"
_LIKED = "(SELECT count(*) > 0 FROM items WHERE user_id = 1)"
_OWN = "(SELECT stars FROM hotels WHERE id = 5)"


def _when(c: str, p: float) -> str:
    return f"CASE WHEN {c} THEN CAST({p} AS DOUBLE) ELSE 0.0 END"


def _say(c: str, t: str) -> str:
    return f"CASE WHEN {c} THEN {t if t.startswith('(') else repr(t)} END"


_S = {
    "best_offers_by_hotel": _best(_STANDARD),
    "best_offers_min_by": _best(_WIDE),
    "best_offers_rank": _best(_STANDARD),
    "best_offers_fallback": _best(_STANDARD, "LEFT JOIN", _SHOWN.replace("name AS", "coalesce(name, 'Hotel ' || hotel_id) AS").replace("stars AS", "coalesce(stars, 4.0) AS")),
    "best_offers_chunks": f"SELECT hotel_id, min_price, CAST(floor((row_number() OVER (ORDER BY min_price, hotel_id) - 1) / 10) AS INTEGER) AS chunk FROM ({_best(_STANDARD)})",
    "best_offers_api_json": "SELECT hotel_id, CAST(to_json({'hotel': {'id': hotel_id, 'name': hotel_name, 'stars': hotel_stars}, 'minPrice': min_price, 'departureDate': strftime(departure_date, '%Y-%m-%d'), "
    "'returnDate': strftime(return_date, '%Y-%m-%d'), 'roomType': room_type, 'mealType': meal_type, 'countAdults': count_adults, 'countChildren': count_children, 'duration': duration, "
    f"'countAvailableOffers': available_offers}}) AS VARCHAR) AS body FROM ({_best(_STANDARD)})",
    "hotel_offers_api_json": "SELECT hotel_id, price, CAST(to_json({'offer': {'price': price, 'countAdults': count_adults, 'countChildren': count_children, 'mealType': meal_type, 'roomType': room_type, 'oceanView': ocean_view}, "
    "'outboundDepartureAirport': outbound_departure_airport, 'inboundDepartureAirport': inbound_departure_airport, "
    + ", ".join(f"'{k}': strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')" for k, c in (("outbundDepartureDatetime", "outbound_departure"), ("outboundArrivalDatetime", "outbound_departure"), ("inboundDepartureDatetime", "inbound_departure"), ("inboundArrivalDatetime", "inbound_departure")))
    + f"}}) AS VARCHAR) AS body FROM offers WHERE hotel_id = 1 AND outbound_departure_airport IN ('FRA', 'MUC') AND {_DATED} ORDER BY {_ORDER} LIMIT 1000",
    "hotel_offers": f"SELECT {_KEYS}, outbound_departure, inbound_departure FROM offers WHERE hotel_id = 1 AND outbound_departure_airport IN ('FRA', 'MUC') AND {_DATED} ORDER BY {_ORDER} LIMIT 1000",
    "first_n_matches": f"SELECT {_KEYS} FROM offers WHERE {_STANDARD} ORDER BY {_ORDER} LIMIT 20",
    "merge_results": "SELECT DISTINCT hotel_id, min_price, departure_date, room_type, meal_type FROM (SELECT *, row_number() OVER (PARTITION BY hotel_id, min_price, departure_date ORDER BY room_type, meal_type) AS k FROM ("
    + " UNION ALL ".join(f"SELECT * FROM ({_best(_STANDARD.replace(chr(40) + chr(39) + 'FRA' + chr(39) + ', ' + chr(39) + 'MUC' + chr(39) + chr(41), a))})" for a in ("('FRA')", "('MUC')", "('FRA', 'MUC')")) + ")) WHERE k = 1",
    **{k: f"SELECT {_KEYS} FROM offers WHERE {w}" for k, w in _FILTERS.items()},
    "arrival_default": f"SELECT {_KEYS}, outbound_departure + INTERVAL 2 HOUR AS outbound_arrival, inbound_departure + INTERVAL 2 HOUR AS inbound_arrival FROM offers",
    "offers_known_hotels": "SELECT hotel_id, count(*) AS n FROM offers WHERE hotel_id IN (SELECT id FROM hotels) GROUP BY ALL",
    "orphan_offers": "SELECT hotel_id, count(*) AS orphan_offers FROM offers WHERE hotel_id NOT IN (SELECT id FROM hotels) GROUP BY ALL",
    "hotel_mapping_stats": "SELECT count(*) AS total, count(id) AS matched, count(*) - count(id) AS unmatched, count(id) / count(*) AS match_rate FROM (SELECT DISTINCT hotel_id FROM offers) LEFT JOIN hotels ON id = hotel_id",
    "hotel_mapping_fallback": (
        "SELECT hotel_id, coalesce(name, 'Hotel ' || hotel_id) AS name, coalesce(stars, CAST(3 + list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(CAST(hotel_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: a * 31 + c) % 3 AS DOUBLE)) AS stars, id IS NOT NULL AS is_mapped "
        "FROM (SELECT DISTINCT hotel_id FROM offers) LEFT JOIN hotels ON id = hotel_id"
    ),
    "offers_per_hotel": "SELECT hotel_id, count(*) AS total_offers FROM offers GROUP BY ALL",
    "largest_hotel": "SELECT hotel_id, count(*) AS total_offers FROM offers GROUP BY ALL ORDER BY total_offers DESC, hotel_id LIMIT 1",
    "index_stats": f"SELECT count(*) AS offers, count(DISTINCT hotel_id) AS hotels, count(DISTINCT {_MONTH}) AS months, count(DISTINCT count_adults || 'a' || count_children) AS passenger_combos, count(DISTINCT meal_type) AS meals, count(DISTINCT room_type) AS rooms, (SELECT count(DISTINCT a) FROM (SELECT outbound_departure_airport AS a FROM offers UNION ALL SELECT inbound_departure_airport FROM offers)) AS airports FROM offers",
    "airport_index_counts": "SELECT a AS airport, count(*) AS n FROM (SELECT outbound_departure_airport AS a FROM offers UNION ALL SELECT inbound_departure_airport FROM offers) GROUP BY ALL",
    "airport_any_counts": "SELECT a AS airport, count(*) AS n FROM (SELECT unnest(list_distinct([outbound_departure_airport, inbound_departure_airport, outbound_arrival_airport, inbound_arrival_airport])) AS a FROM offers) GROUP BY ALL",
    "month_index_counts": f"SELECT {_MONTH} AS month, count(*) AS n FROM offers GROUP BY ALL",
    "month0_counts": "SELECT year(outbound_departure) || '-' || (month(outbound_departure) - 1) AS month, count(*) AS n FROM offers GROUP BY ALL",
    "passenger_index_counts": "SELECT count_adults || 'a' || count_children || 'c' AS passengers, count(*) AS n FROM offers GROUP BY ALL",
    "price_range_counts": "SELECT r.n AS price_range, count(*) AS n FROM offers JOIN (VALUES ('0-100', 0, 100), ('100-200', 100, 200), ('200-500', 200, 500), ('500-1000', 500, 1000), ('1000+', 1000, 1e300)) r(n, lo, hi) ON price BETWEEN lo AND hi GROUP BY r.n",
    "price_bucket_counts": "SELECT CAST(floor(price / 50) * 50 AS BIGINT) AS bucket, count(*) AS n FROM offers GROUP BY ALL",
    "index_memory_estimate": "SELECT k AS index_name, m * n AS entries, m * n * 8 AS bytes FROM (SELECT count(*) AS n FROM offers), (VALUES ('airport', 2), ('hotel', 1), ('month', 1), ('passenger', 1)) v(k, m)",
    "filter_options": "SELECT DISTINCT 'airport' AS kind, outbound_departure_airport AS value FROM offers UNION SELECT 'meal', meal_type FROM offers UNION SELECT 'room', room_type FROM offers",
    "bitset_counts": "SELECT (SELECT count(*) FROM a) AS first, (SELECT count(*) FROM b) AS second, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS either",
    "index_selectivity": "SELECT k AS index_name, c AS candidates, c / (SELECT count(*) FROM offers) AS selectivity FROM (SELECT 'airport' AS k, count(*) AS c FROM offers WHERE outbound_departure_airport IN ('FRA', 'MUC') UNION ALL SELECT 'passengers', count(*) FROM offers WHERE count_adults = 2 AND count_children = 0 UNION ALL SELECT 'nights', count(*) FROM offers WHERE duration = 7)",
    "candidates_by_airport": "SELECT hotel_id, count(*) AS n FROM offers WHERE outbound_departure_airport IN ('FRA', 'PMI') OR inbound_departure_airport IN ('FRA', 'PMI') GROUP BY ALL",
    "candidates_by_date": f"SELECT {_KEYS}, outbound_departure FROM offers WHERE {_CANDIDATES_DATE}",
    "candidates_by_passengers": "SELECT hotel_id, count(*) AS n FROM offers WHERE count_adults = 2 AND count_children = 0 GROUP BY ALL",
    "index_intersection": f"SELECT {_KEYS} FROM offers WHERE (outbound_departure_airport = 'FRA' OR inbound_departure_airport = 'FRA') AND {_CANDIDATES_DATE} AND count_adults = 2 AND count_children = 0",
    "bucket_search": f"SELECT {_KEYS} FROM offers WHERE hotel_id IN (1, 2, 3, 4) AND outbound_departure_airport IN ('FRA', 'MUC') AND floor(price / 50) * 50 BETWEEN 100 AND 450 ORDER BY hotel_id, price, outbound_departure, l_orderkey, l_partkey, l_linenumber LIMIT 1000",
    "dedupe_key9": f"SELECT {_KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY hotel_id, price, count_adults, count_children, outbound_departure, inbound_departure, outbound_departure_airport, meal_type, room_type ORDER BY l_orderkey DESC, l_partkey DESC, l_linenumber DESC) AS rn FROM offers) WHERE rn = 1",
    "mock_hotels": "SELECT i AS id, 'Hotel ' || i AS name, CAST(3 + i % 3 AS DOUBLE) AS stars FROM range(1, 101) r(i)",
    "ingest_offers_named": _parsed("duration, ocean_view"),
    "ingest_offers_pos15": _parsed("duration, true AS ocean_view"),
    "ingest_offers_pos14": _parsed("9 AS duration, true AS ocean_view"),
    "ingest_stats": "SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS valid, count(*) FILTER (WHERE NOT ok) AS errors, count(*) FILTER (WHERE ok) / count(*) AS success_rate FROM (SELECT l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AND l_partkey % 23 <> 0 AS ok FROM offers)",
    "ingest_hotels": "SELECT s_suppkey + 1 AS id, s_name AS name, CAST(s_suppkey % 7 AS DOUBLE) AS stars FROM supplier WHERE s_suppkey % 17 <> 0 AND s_suppkey % 19 <> 0 AND s_suppkey % 7 <= 5",
    "parse_dates": "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN date_trunc('second', ts) ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS parsed FROM events",
    "typed_parse": "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_id END AS whole, CASE WHEN event_id % 4 < 2 THEN event_id END AS prefix, CASE WHEN event_id % 4 >= 2 THEN true WHEN event_id = 0 THEN false END AS flag, event_id % 4 = 3 AS strict FROM events",
    "parse_criteria": "SELECT event_id, 'fra|' || event_type AS airports, CAST(CASE WHEN event_id % 3 <> 0 THEN 7 END AS INTEGER) AS duration FROM events",
    "date_utils": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, date_trunc('day', ts) AS day_start, date_trunc('day', ts) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS day_end, ts + INTERVAL 7 DAY AS week_later, ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-02-10' AS in_range FROM events",
    "duration_nights": "SELECT duration AS nights, elapsed, count(*) AS n FROM offers GROUP BY ALL",
    "months_in_range": "SELECT strftime(m, '%Y-%m') AS month, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('month', outbound_departure)::TIMESTAMP, date_trunc('month', inbound_departure)::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM offers) GROUP BY ALL",
    "validate_hotel_id": "SELECT event_id, h AS hotel_id, regexp_full_match(h, '[1-9][0-9]*') AS valid FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '0' WHEN 1 THEN '0' || event_id WHEN 2 THEN 'a1' ELSE CAST(event_id AS VARCHAR) END AS h FROM events)",
    "validate_offers": "SELECT array_to_string(list_filter([CASE WHEN l_partkey % 17 = 0 THEN 'price must not be negative' END, CASE WHEN l_partkey % 19 = 0 THEN 'meal_type is required' END], lambda x: x IS NOT NULL), '; ') AS errors, count(*) AS n FROM offers GROUP BY ALL",
    "validate_hotels": "SELECT s_suppkey AS id, array_to_string(list_filter([CASE WHEN s_suppkey <= 0 THEN 'id must be positive' END, CASE WHEN s_suppkey % 5 = 0 OR trim(s_name) = '' THEN 'name is required' END, CASE WHEN s_suppkey % 8 > 5 THEN 'stars must be 0 to 5' END], lambda x: x IS NOT NULL), '; ') AS errors FROM supplier",
    "validate_criteria": """SELECT event_id, CAST(len(e) AS INTEGER) AS n_errors, array_to_string(e, '; ') AS errors FROM (SELECT event_id, list_filter([
      CASE WHEN event_id % 4 = 2 THEN 'at least one departure airport is required' END, CASE WHEN event_id % 4 = 1 THEN 'airports must have three letters' END, CASE WHEN event_id % 5 <= 1 THEN 'earliest departure must be before latest return' END,
      CASE WHEN event_id % 400 NOT BETWEEN 1 AND 365 THEN 'duration must be 1 to 365' END, CASE WHEN event_id % 12 NOT BETWEEN 1 AND 10 THEN 'adults must be 1 to 10' END, CASE WHEN event_id % 13 - 1 NOT BETWEEN 0 AND 10 THEN 'children must be 0 to 10' END,
      CASE WHEN event_id % 6 = 0 THEN 'minimum price must not be negative' END, CASE WHEN event_id % 6 = 1 AND event_id % 7 = 0 THEN 'minimum price must not exceed maximum price' END, CASE WHEN event_id % 9 = 0 THEN 'stars must be 0 to 5' END], lambda x: x IS NOT NULL) AS e FROM events)""",
    "data_quality": "SELECT count(*) AS offers, count(*) FILTER (WHERE hotel_id IS NULL) AS empty_ids, count(*) FILTER (WHERE inbound_departure < outbound_departure) AS bad_dates, count(*) FILTER (WHERE NOT (price > 0 AND price <= 50000)) AS bad_prices, count(*) FILTER (WHERE id IS NULL) AS orphans FROM offers LEFT JOIN hotels ON id = hotel_id",
    "criteria_degrade": " UNION ALL ".join(f"SELECT '{k}' AS level, count(*) AS n FROM offers WHERE outbound_departure_airport IN ({a}) AND outbound_departure >= TIMESTAMP '1996-01-01' AND inbound_departure <= TIMESTAMP '{e}'" for k, a, e in (("low", "'FRA', 'MUC', 'DUS', 'HAM', 'BER', 'CGN'", "1996-12-31"), ("medium", "'FRA', 'MUC', 'DUS', 'HAM', 'BER'", "1996-12-31"), ("high", "'FRA', 'MUC', 'DUS'", "1996-01-31"), ("critical", "'FRA'", "1996-01-31"))),
    "cache_key": "SELECT event_id, array_to_string(list_sort(['MUC', 'FRA', event_type]), ',') || '|' || user_id || '|' AS key FROM events",
    "request_summary": f"SELECT count(*) AS total, avg(duration_ms) AS avg_ms, {_SLOW} AS slow_percent FROM requests",
    "request_by_endpoint": f"SELECT endpoint, count(*) AS total, avg(duration_ms) AS avg_ms, max(duration_ms) AS max_ms, min(duration_ms) AS min_ms, {_SLOW} AS slow_percent FROM requests GROUP BY ALL",
    "request_levels": "SELECT CASE WHEN duration_ms > 5000 THEN 'error' WHEN duration_ms > 1000 THEN 'warn' ELSE 'info' END AS level, count(*) AS n FROM requests GROUP BY ALL",
    "recent_slow_requests": "SELECT event_id, endpoint, duration_ms, ts FROM (SELECT * FROM requests ORDER BY ts DESC, event_id DESC LIMIT 1000) WHERE duration_ms > 1000 ORDER BY ts DESC, event_id DESC LIMIT 20",
    "sustained_slow_alerts": "SELECT event_id, endpoint, t, slow_count FROM (SELECT *, count(*) OVER (PARTITION BY endpoint ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS slow_count FROM (SELECT event_id, endpoint, epoch_us(ts) // 60 AS t FROM requests WHERE duration_ms > 1000)) WHERE slow_count >= 5",
    "search_stats": "SELECT endpoint, count(*) AS total, avg(duration_ms) AS avg_ms, count(*) FILTER (WHERE duration_ms > 1000) AS slow, avg(duration_ms) FILTER (WHERE rn <= 10) AS recent_avg_ms FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) AS rn FROM requests) GROUP BY ALL",
    "latency_percentiles": "SELECT p, value FROM (SELECT duration_ms AS value, row_number() OVER (ORDER BY duration_ms) AS rn, count(*) OVER () AS n FROM requests), (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) v(p) WHERE rn = ceil(n * p)",
    "cache_hit_rate": "SELECT count(*) AS total, avg(duration_ms) AS avg_ms, avg(CASE WHEN event_id % 3 = 0 THEN 100.0 ELSE 0.0 END)::DOUBLE AS hit_percent FROM requests",
    "error_stats": f"SELECT c AS category, coalesce(n, 0) AS n, coalesce(resolved, 0) AS resolved, coalesce(n, 0) / 10000 AS error_rate, coalesce(n, 0) / 10000 > 0.05 AS alert FROM (VALUES ('memory'), ('io'), ('network'), ('validation'), ('data_processing'), ('unknown')) v(c) LEFT JOIN (SELECT {_CATEGORY} AS c, count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS resolved FROM events GROUP BY 1) USING (c)",
    "error_classify": f"SELECT {_MESSAGE} AS message, {_CATEGORY} AS category, CASE event_id % 8 WHEN 0 THEN 'critical' WHEN 4 THEN 'high' WHEN 7 THEN 'high' ELSE 'low' END AS severity, count(*) AS n FROM events GROUP BY ALL",
    "error_http_map": f"SELECT message, name, CAST(CASE WHEN name = 'ValidationError' OR name = 'TypeError' AND contains(message, 'Cannot read property') THEN 400 WHEN contains(message, 'timeout') THEN 504 WHEN contains(message, 'ENOENT') OR contains(message, 'ECONNREFUSED') OR contains(message, 'network') THEN 503 ELSE 500 END AS INTEGER) AS status, count(*) AS n FROM (SELECT {_MESSAGE} AS message, CASE event_id % 3 WHEN 0 THEN 'ValidationError' WHEN 1 THEN 'TypeError' ELSE 'Error' END AS name FROM events) GROUP BY ALL",
    "ops_statistics": "SELECT avg((event_id % 100) / (value + 1) * 1000.0) AS avg_throughput, avg(value + 1) AS avg_ms, avg(CASE WHEN event_id % 7 <> 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS success_rate, sum(event_id % 100)::BIGINT AS records FROM events",
    "backoff_delays": "SELECT i AS attempt, CAST(least(1000 * power(2, i), 30000) AS BIGINT) AS delay_ms FROM range(10) r(i)",
    "pressure_level": "SELECT CASE WHEN h >= 90 OR s >= 95 THEN 'critical' WHEN h >= 80 OR s >= 85 THEN 'high' WHEN h >= 70 OR s >= 75 THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM (SELECT event_id % 100 AS h, event_id * 7 % 100 AS s FROM events) GROUP BY ALL",
    "search_strategy": "SELECT CASE WHEN i * 5000 > 10000000 OR i % 100 >= 80 THEN 'streaming' WHEN CAST(i % 3 > 1 AS INT) + CAST(i % 2 = 0 AS INT) + CAST(i % 5 = 0 AS INT) + CAST(i % 7 = 0 AS INT) >= 2 AND i % 100 < 70 THEN 'parallel' ELSE 'sequential' END AS strategy, count(*) AS n FROM (SELECT event_id AS i FROM events) GROUP BY ALL",
    "adaptive_config": "SELECT size_class, CAST(CASE size_class WHEN 'small' THEN 1 WHEN 'medium' THEN 2 WHEN 'large' THEN 4 ELSE 8 END AS INTEGER) AS workers, CAST(CASE WHEN h THEN floor(c * 0.7) ELSE c END AS INTEGER) AS chunk_size, CAST(CASE size_class WHEN 'small' THEN 5000 WHEN 'medium' THEN 2000 WHEN 'large' THEN 1000 ELSE 500 END AS INTEGER) AS streaming_threshold, count(*) AS n FROM (SELECT *, CASE size_class WHEN 'small' THEN 5000 WHEN 'medium' THEN 10000 WHEN 'large' THEN 20000 ELSE 50000 END AS c FROM (SELECT event_id % 2 = 0 AS h, CASE WHEN event_id * 2000 < 100000 THEN 'small' WHEN event_id * 2000 < 1000000 THEN 'medium' WHEN event_id * 2000 < 10000000 THEN 'large' ELSE 'massive' END AS size_class FROM events)) GROUP BY ALL",
    "cache_evictions": "SELECT event_id, CASE WHEN 1705000000000000 - us > 300000000 THEN 'expired' WHEN rn <= cut OR us <= (SELECT max(us) FROM (SELECT epoch_us(ts) AS us, row_number() OVER (ORDER BY ts) AS rn, count(*) OVER () AS n FROM events) WHERE rn <= ceil(n * 0.1)) THEN 'oldest' END AS reason FROM (SELECT event_id, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts) AS rn, 0 AS cut FROM events) WHERE reason IS NOT NULL",
    "bitpack_roundtrip": "SELECT CAST(count_adults + count_children * 16 + duration * 256 + CAST(ocean_view AS INTEGER) * 1048576 AS BIGINT) AS code, count_adults AS adults, count_children AS children, duration AS nights, ocean_view AS ocean, count(*) AS n FROM offers GROUP BY ALL",
    "timestamp_day_code": "SELECT CAST(least(65535, greatest(0, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)))) AS INTEGER) AS day_code, count(*) AS n FROM events GROUP BY ALL",
    "dictionary_stats": "SELECT column_name, count(*) AS entries, CAST(sum(strlen(v)) AS BIGINT) AS bytes FROM (SELECT DISTINCT 'meal_type' AS column_name, meal_type AS v FROM offers UNION SELECT 'room_type', room_type FROM offers UNION SELECT 'outbound_departure_airport', outbound_departure_airport FROM offers) GROUP BY ALL",
    "block_layout_stats": "SELECT count(*) AS offers, CAST(ceil(count(*) / 10000) AS BIGINT) AS blocks, CAST((count(*) - 1) % 10000 + 1 AS BIGINT) AS last_block FROM offers",
    "bloom_sizing": "SELECT CAST(n AS BIGINT) AS keys, CAST(m AS BIGINT) AS bits, CAST(ceil(m / n * ln(2)) AS INTEGER) AS hashes, round(power(1 - exp(-ceil(m / n * ln(2)) * n / m), ceil(m / n * ln(2))), 9) AS fpp FROM (SELECT n, ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS m FROM (SELECT power(10.0, i) AS n FROM range(1, 7) r(i)))",
    "counting_membership": "SELECT hotel_id, CAST(sum(CASE action WHEN 'add' THEN 1 ELSE -1 END) AS BIGINT) AS n, sum(CASE action WHEN 'add' THEN 1 ELSE -1 END) > 0 AS member FROM log WHERE action IN ('add', 'remove') GROUP BY ALL",
    "shortlist_notes": "SELECT user_id, hotel_id, arg_max(notes, {'ts': ts, 'event_id': event_id}) AS notes FROM log WHERE action = 'note' GROUP BY ALL",
}

ORACLE_SQL: dict[str, str] = {k: f"{_VIEWS} {v}" for k, v in _S.items()}
ORACLE_SQL["bitset_counts"] = f"{_VIEWS}, a AS (SELECT DISTINCT hotel_id FROM offers WHERE outbound_departure_airport = 'FRA' AND price < 100), b AS (SELECT DISTINCT hotel_id FROM offers WHERE meal_type = 'Breakfast' AND price > 2000) {_S['bitset_counts']}"
ORACLE_SQL |= {
    "shortlist_items": f"{_VIEWS}, {_ITEMS} SELECT user_id, hotel_id, x.ts AS added_at, x.price AS price_when_added FROM items",
    "user_shortlists": f"{_VIEWS}, {_ITEMS} SELECT user_id, created_at, coalesce(n, 0) AS items FROM (SELECT user_id, min(ts) AS created_at FROM log WHERE action IN ('create', 'add') GROUP BY ALL) LEFT JOIN (SELECT user_id, count(*) AS n FROM items GROUP BY ALL) USING (user_id)",
    "is_shortlisted": f"{_VIEWS}, {_ITEMS} SELECT count(*) > 0 AS liked FROM items WHERE user_id = 1",
    "user_price_alerts": f"{_VIEWS}, {_ALERTS} SELECT * FROM alerts",
    "active_price_alerts": f"{_VIEWS}, {_ALERTS} SELECT * FROM alerts WHERE is_active",
    "alerts_triggered": f"{_VIEWS}, {_ALERTS} SELECT alert_id, user_id, hotel_id, target_price, min_price FROM alerts JOIN (SELECT hotel_id, min(price) AS min_price FROM offers GROUP BY ALL) USING (hotel_id) WHERE is_active AND min_price <= target_price",
    "shortlist_stats": f"{_VIEWS}, {_ITEMS}, {_ALERTS.split('), ', 1)[1]} SELECT (SELECT count(DISTINCT user_id) FROM log WHERE action IN ('create', 'add')) AS shortlists, (SELECT count(*) FROM items) AS items, count(DISTINCT user_id) AS alert_users, count(*) AS alerts, count(*) FILTER (WHERE is_active) AS active_alerts FROM alerts",
    "rec_personalized": f"{_VIEWS}, {_ITEMS}" + _top(
        f"hotel_stars + greatest(0.0, 3.0 - min_price / 1000.0) + {_when(_SEA, 1)} + {_when(_FULL, 1)} + {_when(_LIKED, 0.5)} + {_when('duration >= 7', 0.5)} + {_when('available_offers > 10', 0.5)}",
        ", ".join((_say("hotel_stars >= 4", "(CASE WHEN hotel_stars = floor(hotel_stars) THEN CAST(CAST(hotel_stars AS INTEGER) AS VARCHAR) ELSE CAST(hotel_stars AS VARCHAR) END || '-star hotel')"), _say("3.0 - min_price / 1000.0 >= 2", "Great price"), _say(_SEA, "Ocean view"), _say(_FULL, "All inclusive"), _say(_LIKED, "Matches your preferences"), _say("duration >= 7", "Perfect for longer stays"), _say("available_offers > 10", "Great availability"))), 10),
    "rec_similar": _VIEWS + _top(f"greatest(0.0, 5.0 - abs(hotel_stars - {_OWN})) + 2.0", ", ".join((_say(f"hotel_stars = {_OWN}", "Same star rating"), _say(f"abs(hotel_stars - {_OWN}) > 0 AND abs(hotel_stars - {_OWN}) <= 0.5", "Similar star rating"), _say("true", "Similar hotel type"))), 5, f"hotel_id <> 5 AND {_OWN} IS NOT NULL"),
    "rec_trending": _VIEWS + _top(f"{_when('hotel_stars >= 4.5', 3)} + {_when('available_offers > 15', 2)} + {_when('min_price < 500', 2)} + {_when(_FULL, 1)}", ", ".join((_say("hotel_stars >= 4.5", "Highly rated"), _say("available_offers > 15", "High availability"), _say("min_price < 500", "Competitive pricing"), _say(_FULL, "All inclusive package"), _say("true", "Trending destination"))), 10),
    "rec_value_deals": _VIEWS + _top(f"CASE WHEN min_price / 100.0 > 0 THEN hotel_stars / (min_price / 100.0) * 10.0 ELSE 0.0 END + {_when(_FULL, 2)} + {_when('available_offers > 10', 1)}", ", ".join((_say(_FULL, "All inclusive value"), _say("available_offers > 10", "Good availability"), _say("true", "Great value for money"))), 10),
}
