"""Keys, hashes and packed codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hash31(s: Column) -> Column:
    """The 31-polynomial string hash in signed 32 bits."""
    step = lambda a, c: F.pmod(a * 31 + c + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    return F.when(F.length(s) == 0, F.lit(0)).otherwise(F.aggregate(F.transform(F.split(s, ""), lambda c: F.ascii(c).cast("long")), F.lit(0).cast("long"), step))


def passenger_key(adults: Column | str = "count_adults", children: Column | str = "count_children") -> Column:
    return F.concat(_c(adults).cast("string"), F.lit("a"), _c(children).cast("string"), F.lit("c"))


def month_key(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def month0_key(ts: Column | str) -> Column:
    """Year and month from zero, without padding."""
    return F.concat(F.year(_c(ts)).cast("string"), F.lit("-"), (F.month(_c(ts)) - 1).cast("string"))


def price_bucket(price: Column | str, width: float = 50.0) -> Column:
    return (F.floor(_c(price) / width) * width).cast("long")


def day_code(ts: Column | str) -> Column:
    """Days since 2024-01-01 in 16 bits."""
    return F.least(F.lit(65535), F.greatest(F.lit(0), F.datediff(_c(ts), F.lit("2024-01-01").cast("date")))).cast("int")


def pack(adults: Column, children: Column, nights: Column, ocean: Column) -> Column:
    """Four bits of adults and children, twelve of nights, one of ocean view."""
    return adults.cast("long").bitwiseAND(15).bitwiseOR(F.shiftleft(children.cast("long").bitwiseAND(15), 4)).bitwiseOR(F.shiftleft(nights.cast("long").bitwiseAND(4095), 8)).bitwiseOR(F.shiftleft(ocean.cast("long").bitwiseAND(1), 20))


def unpack(code: Column) -> dict[str, Column]:
    part = lambda shift, mask: F.shiftright(code, shift).bitwiseAND(mask).cast("int")
    return {"adults": part(0, 15), "children": part(4, 15), "nights": part(8, 4095), "ocean": part(20, 1) == 1}


def cache_key(airports: Column, *parts: Column) -> Column:
    """Criteria in one form: airports sorted, all joined; equal criteria have equal keys."""
    return F.concat_ws("|", F.concat_ws(",", F.array_sort(airports)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def criteria_key(fields: dict[str, Column]) -> Column:
    """Criteria of any order of fields in one form: names sorted, arrays sorted, times as milliseconds; equal criteria have equal keys.

    Values are given by name; arrays and times are told by :func:`sorted_values` and :func:`epoch_ms`.
    """
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def sorted_values(a: Column) -> Column:
    return F.array_sort(a)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def number_text(x: Column) -> Column:
    """A number without a fraction where it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def round_half_up(x: Column, digits: int = 1) -> Column:
    return F.floor(x * 10**digits + 0.5).cast("double") / float(10**digits)
