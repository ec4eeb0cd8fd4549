"""Column builders that take values out of records."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A field: a column name, a position, or a function of a record's columns.
Spec = str | int | Callable[[DataFrame], Column] | Column


def getter(df: DataFrame, spec: Spec) -> Column:
    if isinstance(spec, Column):
        return spec
    if isinstance(spec, bool):
        raise TypeError(f"not a field: {spec!r}")
    if isinstance(spec, int):
        return F.col(f"`{df.columns[spec]}`")
    if isinstance(spec, str):
        return F.col("`" + spec.replace("`", "``") + "`") if spec in df.columns else F.col(spec)
    if callable(spec):
        return spec(df)
    raise TypeError(f"not a field: {spec!r}")


def dict_get(mapping: Column, key: str) -> Column:
    """A map's value; null for a key it lacks."""
    return F.try_element_at(mapping, F.lit(key))


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def fallback(*columns: Column, test: Callable[[Column], Column] = truthy, default="") -> Column:
    """The first value that passes the test."""
    if not callable(test):
        raise TypeError("test is not callable")
    return F.coalesce(*(F.when(test(c), c) for c in columns), F.lit(default))


def _values(parts: Column) -> Column:
    """Trimmed, blanks dropped; order and repetitions stay."""
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def combine(*columns: Column) -> Column:
    return _values(F.array_compact(F.array(*(c.cast("string") for c in columns))))


def multivalue(sep: str, *columns: Column) -> Column:
    """Columns split at a literal separator, end to end; a null column gives nothing."""
    empty = F.array().cast("array<string>")
    return _values(F.flatten(F.array(*(F.coalesce(F.split(c, re.escape(sep) if sep else ""), empty) for c in columns))))


def convert(column: Column, converter: Callable[[Column], Column]) -> Column:
    return converter(column)


def list_convert(column: Column, converter: Callable[[Column], Column]) -> Column:
    return F.transform(column, converter)


def wrap(*functions: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Composition, right to left; without functions the identity."""
    return lambda c: reduce(lambda x, f: f(x), reversed(functions), c)


def delnone(items: Column) -> Column:
    return F.array_compact(items)


def nullmax(items: Column) -> Column:
    """Greatest element, nulls left out; null for an empty or all-null array."""
    return F.array_max(items)
