"""Declared table layouts. Nothing is inferred from the files."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DateType(), "l": T.LongType(), "f": T.DoubleType(), "i": T.IntegerType()}
    return T.StructType([T.StructField(n, kinds[k], True) for n, k in fields])


# Column names and order of the input files.
FACTS = _s(("date_show", "d"), ("cinema_ids", "s"), ("city_name", "s"), ("movie_title", "s"),
           ("total_ticket", "l"), ("occupation_rate", "f"), ("total_show", "l"))
REQUESTS = _s(("id", "l"), ("movie_title", "s"), ("cinema_ids", "s"), ("city_name", "s"), ("date_show", "d"))
RESULTS = _s(("id", "l"), ("total_ticket", "l"))
ITEMS = _s(("original_title", "s"), ("age_rating", "s"), ("genre", "s"), ("producer", "s"),
           ("director", "s"), ("writer", "s"), ("casts", "s"))
HOLIDAYS = _s(("date", "d"), ("day_tipe", "s"), ("holiday_tipe", "s"), ("holiday_name", "s"))
PRICES = _s(("city_name", "s"), ("ceil", "l"), ("price_day", "s"))
PREDICTIONS = _s(("id", "l"), ("ratio", "f"), ("scale", "f"), ("h", "i"), ("leb", "i"), ("ram_exp", "f"))
INTERVALS = _s(("kind", "s"), ("start", "d"), ("end", "d"))
LEDGER = _s(("file", "s"), ("expected", "f"), ("actual", "f"), ("config", "s"))
