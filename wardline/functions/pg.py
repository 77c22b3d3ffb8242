"""PostgreSQL-compatible column functions.

Spark and PostgreSQL disagree on a handful of scalar semantics (null ordering, integer
division, rounding casts, ``substring`` below position one, ``array_agg`` nulls, ...).
Each function here builds a built-in Spark expression with the PostgreSQL result, so the
work stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ColumnLike = Column | str


def _c(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- ordering -----------------------------------------------------------------------


def asc(column: ColumnLike) -> Column:
    """Ascending, nulls last."""
    return _c(column).asc_nulls_last()


def desc(column: ColumnLike) -> Column:
    """Descending, nulls first."""
    return _c(column).desc_nulls_first()


# --- arithmetic and casts -----------------------------------------------------------


def int_div(left: ColumnLike, right: ColumnLike) -> Column:
    """Integer division truncating toward zero; division by zero is an error."""
    return F.call_function("div", _c(left), _c(right))


def double_to_int(value: ColumnLike, target: str = "bigint") -> Column:
    """``double -> integer``: ties go to the even neighbour."""
    return F.rint(_c(value)).cast(target)


def decimal_to_int(value: ColumnLike, target: str = "bigint") -> Column:
    """``numeric -> integer``: ties go away from zero."""
    return F.round(_c(value), 0).cast(target)


# --- strings ------------------------------------------------------------------------


def substring(value: ColumnLike, start: int, length: int | None = None) -> Column:
    """``substring(s FROM start FOR length)``; positions before the first character are empty."""
    first = max(start, 1)
    if length is None:
        return F.substring(_c(value), first, 2**31 - 1)
    if length < 0:
        raise ValueError("negative substring length not allowed")
    return F.substring(_c(value), first, max(start + length - first, 0))


# --- dates and times ----------------------------------------------------------------


def to_timestamp(value: ColumnLike) -> Column:
    """Read an ISO date or timestamp as a zone-less timestamp; a trailing zone is ignored."""
    return _c(value).cast("timestamp_ntz")


def date(value: ColumnLike) -> Column:
    return _c(value).cast("date")


def date_trunc(unit: str, value: ColumnLike) -> Column:
    """``date_trunc`` that keeps the zone-less type."""
    return F.date_trunc(unit, _c(value)).cast("timestamp_ntz")


def extract(part: str, value: ColumnLike) -> Column:
    """``extract(part FROM ts)``; Sunday is 0 for ``dow`` and ``epoch`` is in seconds."""
    name = part.lower()
    if name == "epoch":
        return F.unix_micros(_c(value).cast("timestamp")) / F.lit(1_000_000)
    if name == "dow":
        return F.dayofweek(_c(value)) - F.lit(1)
    if name == "isodow":
        return F.weekday(_c(value)) + F.lit(1)
    return F.extract(F.lit(name), _c(value))


# --- conditional aggregates ---------------------------------------------------------


def array_agg(value: ColumnLike) -> Column:
    """``array_agg(x)``: keeps NULL elements and is NULL for an empty group."""
    boxed = F.collect_list(F.struct(_c(value).alias("v")))
    return F.when(F.size(boxed) > 0, F.transform(boxed, lambda item: item["v"]))


def array_agg_distinct_sorted(value: ColumnLike) -> Column:
    """``array_agg(DISTINCT x ORDER BY x) FILTER (WHERE x IS NOT NULL)``."""
    found = F.array_sort(F.collect_set(_c(value)))
    return F.when(F.size(found) > 0, found)


def agg_filter(aggregate, value: Column, condition: Column) -> Column:
    """``aggregate(value) FILTER (WHERE condition)`` for null-ignoring aggregates."""
    return aggregate(F.when(condition, value))
