"""Dirty text to typed values; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The dates that are understood, beside ISO forms with an offset. Year first: yyyy-MM-dd, alone or with
#: " HH:mm", " HH:mm:ss" or "THH:mm:ss". Day first: dd/MM/yyyy and dd-MM-yyyy, alone or with " HH:mm:ss" or "THH:mm:ss".
YEAR_FIRST = r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}|[ T]\d{2}:\d{2}:\d{2})?$"
DAY_FIRST = r"^\d{2}([/-])\d{2}\1\d{4}([ T]\d{2}:\d{2}:\d{2})?$"
WITH_OFFSET = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def parse_date(s: Column) -> Column:
    """A timestamp in UTC without zone; ISO forms with an offset are moved to UTC.

    Places of the parts are fixed, so a date with its day first is put year first, and one cast reads both; a formatter for
    each form costs several times as much.
    """
    s = F.trim(s)
    dash = F.lit("-")
    turned = F.concat(F.substring(s, 7, 4), dash, F.substring(s, 4, 2), dash, F.substring(s, 1, 2), F.substring(s, 11, 9))
    iso = F.when(s.rlike(YEAR_FIRST), s).when(s.rlike(DAY_FIRST), turned)
    return F.when(s.rlike(WITH_OFFSET), F.try_to_timestamp(s).cast("timestamp_ntz")).otherwise(iso.try_cast("timestamp_ntz"))


def in_range(ts: Column, earliest: Column, latest: Column) -> Column:
    return ts.between(earliest, latest)


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def day_start(ts: Column) -> Column:
    return F.date_trunc("DAY", ts).cast("timestamp_ntz")


def day_end(ts: Column) -> Column:
    """The last millisecond of the day."""
    return day_start(ts) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MILLISECOND")


def add_days(ts: Column, n: int) -> Column:
    return ts + F.expr(f"INTERVAL {int(n)} DAYS")


def same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def months_between_dates(a: Column, b: Column) -> Column:
    """The first days of the months from a's to b's."""
    return F.sequence(F.trunc(a, "MM"), F.trunc(b, "MM"), F.expr("INTERVAL 1 MONTH"))


def parse_prefix_number(s: Column) -> Column:
    """The number that a text begins with, with a fraction and an exponent if it has them."""
    return F.nullif(F.regexp_extract(F.trim(s), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0), F.lit("")).try_cast("double")


def unquote(s: Column) -> Column:
    return F.when(F.contains(s, F.lit('"')), F.regexp_replace(s, '^"|"$', "")).otherwise(s)


def parse_number(s: Column) -> Column:
    return F.trim(s).try_cast("double")


def parse_integer(s: Column) -> Column:
    return F.when(F.trim(s).rlike(r"^[+-]?\d+$"), F.trim(s).try_cast("long"))


def parse_prefix_integer(s: Column) -> Column:
    """The integer that a text begins with."""
    return F.nullif(F.regexp_extract(F.trim(s), r"^-?\d+", 0), F.lit("")).try_cast("long")


def parse_boolean(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(t.isin("true", "1", "yes"), F.lit(True)).when(t.isin("false", "0", "no"), F.lit(False))


def strict_true(s: Column) -> Column:
    return F.coalesce(s == "true", F.lit(False))


def split_list(s: Column) -> Column:
    return F.transform(F.split(s, ","), lambda x: F.trim(x))
