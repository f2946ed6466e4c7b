"""The service's answers as JSON rows, and requests as criteria."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.operators import mapping, metrics, recommend, search, userstate
from wayfare.operators.cache import ResultCache
from wayfare.operators.criteria import SearchCriteria
from wayfare.operators.indexes import filter_options, index_stats


def best_offers_json(best: DataFrame) -> DataFrame:
    """(hotel_id, body): one record for each hotel, with a nested hotel and dates as days."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    body = F.struct(
        F.struct(F.col("hotel_id").alias("id"), F.col("hotel_name").alias("name"), F.col("hotel_stars").alias("stars")).alias("hotel"), F.col("min_price").alias("minPrice"), day("departure_date").alias("departureDate"), day("return_date").alias("returnDate"),
        F.col("room_type").alias("roomType"), F.col("meal_type").alias("mealType"), F.col("count_adults").alias("countAdults"), F.col("count_children").alias("countChildren"), "duration", F.col("available_offers").alias("countAvailableOffers"),
    )
    return best.select("hotel_id", F.to_json(body).alias("body"))


def hotel_offers_json(offers: DataFrame) -> DataFrame:
    """(hotel_id, price, body): one record for each offer; the interface gives departure times as arrival times."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.struct(
        F.struct("price", F.col("count_adults").alias("countAdults"), F.col("count_children").alias("countChildren"), F.col("meal_type").alias("mealType"), F.col("room_type").alias("roomType"), F.col("ocean_view").alias("oceanView")).alias("offer"),
        F.col("outbound_departure_airport").alias("outboundDepartureAirport"), F.col("inbound_departure_airport").alias("inboundDepartureAirport"), iso("outbound_departure").alias("outbundDepartureDatetime"),
        iso("outbound_departure").alias("outboundArrivalDatetime"), iso("inbound_departure").alias("inboundDepartureDatetime"), iso("inbound_departure").alias("inboundArrivalDatetime"),
    )
    return offers.select("hotel_id", "price", F.to_json(body).alias("body"))


def criteria_of(params: dict[str, str]) -> SearchCriteria:
    """Criteria from request parameters; ValueError where a required one is missing or malformed."""
    need = ("departureAirports", "earliestDepartureDate", "latestReturnDate", "duration", "countAdults", "countChildren")
    if missing := [k for k in need if not params.get(k)]:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    airports = tuple(a.strip() for a in params["departureAirports"].split(",") if a.strip())
    if not airports or any(len(a) != 3 for a in airports):
        raise ValueError("airports must have three letters")
    c = SearchCriteria(airports, datetime.fromisoformat(params["earliestDepartureDate"]), datetime.fromisoformat(params["latestReturnDate"]), int(params["duration"]), int(params["countAdults"]), int(params["countChildren"]))
    if not (c.earliest_departure < c.latest_return and 1 <= c.duration <= 365 and 1 <= c.count_adults <= 10 and 0 <= c.count_children <= 10):
        raise ValueError("parameters out of range")
    return c


@dataclass
class Service:
    """The service over its tables: a method for each route. Answers are DataFrames or plain values, statuses those of the HTTP
    interface; methods that change something give the service with the action appended to its log."""

    offers: DataFrame
    hotels: DataFrame
    log: DataFrame | None = None
    cache: ResultCache = field(default_factory=ResultCache)
    requests: DataFrame | None = None

    # searches

    def best_offers(self, params: dict[str, str], limit: int | None = None) -> tuple[int, DataFrame | str]:
        try:
            c = criteria_of(params)
        except ValueError as e:
            return 400, str(e)
        key = "best|" + "&".join(f"{k}={v}" for k, v in sorted(params.items())) + f"|{limit}"
        return 200, self.cache.get(key, lambda: best_offers_json(search.best_offers(self.offers, self.hotels, c, limit)))

    def hotel_offers(self, hotel_id: str, params: dict[str, str], limit: int = 1000, offset: int = 0) -> tuple[int, DataFrame | str]:
        if not hotel_id.isdigit() or hotel_id.startswith("0"):
            return 400, "hotel id must be a positive integer"
        try:
            c = criteria_of(params)
        except ValueError as e:
            return 400, str(e)
        if not self.hotels.where(F.col("id") == int(hotel_id)).take(1):
            return 404, "unknown hotel"
        return 200, hotel_offers_json(search.hotel_offers(self.offers, int(hotel_id), c, limit, offset))

    # recommendations

    def _best(self, c: SearchCriteria) -> DataFrame:
        return search.best_offers(self.offers, self.hotels, c)

    def recommendations(self, user_id: int, c: SearchCriteria) -> DataFrame:
        return recommend.personalized(self._best(c), userstate.is_shortlisted(userstate.shortlist_items(self._lists()), user_id))

    def similar(self, hotel_id: int, c: SearchCriteria) -> DataFrame:
        return recommend.similar(self._best(c), self.hotels, hotel_id)

    def trending(self, c: SearchCriteria) -> DataFrame:
        return recommend.trending(self._best(c))

    def value_deals(self, c: SearchCriteria) -> DataFrame:
        return recommend.value_deals(self._best(c))

    # shortlists and price alerts

    def _lists(self) -> DataFrame:
        return userstate.since_deletion(self.log)

    def act(self, event_id: int, ts: datetime, action: str, **values) -> Service:
        """The service after one action; values are columns of the log."""
        row = {"event_id": event_id, "ts": ts, "action": action, **values}
        one = self.log.sparkSession.createDataFrame([tuple(row.get(c) for c in self.log.columns)], self.log.schema)
        return replace(self, log=self.log.union(one))

    def create_shortlist(self, event_id: int, ts: datetime, user_id: int) -> Service:
        return self.act(event_id, ts, "create", user_id=user_id)

    def user_shortlists(self, user_id: int) -> DataFrame:
        return userstate.user_shortlists(self._lists()).where(F.col("user_id") == user_id)

    def shortlist_items(self, user_id: int) -> DataFrame:
        return userstate.shortlist_items(self._lists()).where(F.col("user_id") == user_id)

    def add_item(self, event_id: int, ts: datetime, user_id: int, hotel_id: int, price: float) -> Service:
        return self.act(event_id, ts, "add", user_id=user_id, hotel_id=hotel_id, price=price)

    def remove_item(self, event_id: int, ts: datetime, user_id: int, hotel_id: int) -> Service:
        return self.act(event_id, ts, "remove", user_id=user_id, hotel_id=hotel_id)

    def delete_shortlist(self, event_id: int, ts: datetime, user_id: int) -> Service:
        return self.act(event_id, ts, "delete", user_id=user_id)

    def create_alert(self, event_id: int, ts: datetime, user_id: int, hotel_id: int, target_price: float) -> tuple[int, Service | str]:
        if target_price <= 0:
            return 400, "target price must be positive"
        return 201, self.act(event_id, ts, "alert", user_id=user_id, hotel_id=hotel_id, target_price=target_price)

    def user_alerts(self, user_id: int) -> DataFrame:
        return userstate.alert_states(self.log).where(F.col("user_id") == user_id)

    def _on_alert(self, event_id: int, ts: datetime, alert_id: int, action: str) -> tuple[int, Service | str]:
        if not userstate.alert_states(self.log).where(F.col("alert_id") == alert_id).take(1):
            return 404, "unknown alert"
        return 200, self.act(event_id, ts, action, alert_id=alert_id)

    def update_alert(self, event_id: int, ts: datetime, alert_id: int, is_active: bool) -> tuple[int, Service | str]:
        return self._on_alert(event_id, ts, alert_id, "activate" if is_active else "deactivate")

    def delete_alert(self, event_id: int, ts: datetime, alert_id: int) -> tuple[int, Service | str]:
        return self._on_alert(event_id, ts, alert_id, "delete_alert")

    # filters, mapping, operation

    def filters(self) -> DataFrame:
        return filter_options(self.offers)

    def _options(self, column: str) -> DataFrame:
        return self.offers.select(F.col(column).alias("value")).where("value IS NOT NULL").distinct().orderBy("value")

    def meal_types(self) -> DataFrame:
        return self._options("meal_type")

    def room_types(self) -> DataFrame:
        return self._options("room_type")

    def airports(self) -> DataFrame:
        return self._options("outbound_departure_airport")

    def mapping(self) -> DataFrame:
        return mapping.stats(self.offers, self.hotels)

    def cache_stats(self) -> dict[str, float]:
        return self.cache.stats()

    def clear_cache(self) -> None:
        self.cache.clear()

    def health(self) -> dict[str, bool]:
        """Whether there are offers and hotels to search."""
        parts = {"offers": bool(self.offers.take(1)), "hotels": bool(self.hotels.take(1))}
        return {"healthy": all(parts.values()), **parts}

    def status(self) -> DataFrame:
        """One row: the cardinalities of the offers."""
        return index_stats(self.offers)

    def metrics(self) -> DataFrame:
        """By endpoint, from the log of requests."""
        return metrics.request_by_endpoint(self.requests)
