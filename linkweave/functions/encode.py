"""Text normalisers, Column to Column.

Null and '' give null, whereas a text may well become ''. Classes are ASCII, but
stripping takes all white space.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: \b between ASCII word characters; the JVM's own is Unicode-aware.
_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def _some(c: Column, result: Column) -> Column:
    return F.when(c.isNotNull() & (c != ""), result)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normspace(c: Column) -> Column:
    return _some(c, F.regexp_replace(strip(c), r"\s+", " "))


def alnumcase(c: Column) -> Column:
    return _some(c, F.trim(F.regexp_replace(c, r"\W+", " ")))


def alnumsp(c: Column) -> Column:
    return alnumcase(F.lower(c))


def nospace(c: Column) -> Column:
    return _some(c, F.regexp_replace(strip(c), r"\s+", ""))


def lowstrip(c: Column) -> Column:
    return normspace(F.lower(c))


def digits(c: Column) -> Column:
    return _some(c, F.regexp_replace(c, r"\D+", ""))


def sorted_words(c: Column) -> Column:
    """Parts between single spaces, in order; empty ones first."""
    return _some(c, F.array_join(F.array_sort(F.split(c, " ")), " "))


def reverse(c: Column) -> Column:
    return _some(c, F.reverse(c))


def urldomain(c: Column, strict_http: bool = True) -> Column:
    """Host without www. As documented only http:// is taken off; `strict_http=False`
    takes off https:// too. What has no host stays as it is."""
    scheme = "http://" if strict_http else "https?://"
    pattern = rf"^(?:{scheme})?(?:www\.)?([^/]+)(?:/.*)?"
    return _some(c, F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c))


def emaildomain(c: Column) -> Column:
    """What follows the first @; without one, the text."""
    pattern = "^([^@]+)@(.+)"
    return _some(c, F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 2)).otherwise(c))


def _template(primary: str) -> str:
    r"""A replacement with \\1 or \\g<1> for a group, in the JVM's notation."""
    parts = re.split(r"\\(?:g<(\d+)>|([1-9]\d?)|(\\))", primary)
    out = parts[0].replace("\\", "\\\\").replace("$", r"\$")
    for g, n, slash, rest in zip(*(parts[i::4] for i in (1, 2, 3, 4)), strict=True):
        out += ("\\\\" if slash else f"${{G{g or n}}}") + rest.replace("\\", "\\\\").replace("$", r"\$")
    return re.sub(r"\$\{G(\d+)\}(?=(.?))", lambda m: f"${m[1]}" + ("\\" if m[2].isdigit() else ""), out)


class Normaliser:
    """Replaces aliases (pattern fragments, any case, whole words) by their primary
    form, in the order given. A primary form may name groups: \\1 is the alias found,
    and the aliases' own groups follow."""

    def __init__(self, aliases: Mapping[str, Sequence[str]]):
        self.rules = [(f"(?i){_EDGE}({'|'.join(a)}){_EDGE}", _template(primary)) for primary, a in aliases.items()]

    def __call__(self, c: Column) -> Column:
        out = c
        for pattern, primary in self.rules:
            out = F.regexp_replace(out, pattern, primary)
        return _some(c, strip(out))

    normalise = __call__


def scale(value: Column, low: float = 0.0, high: float = 1.0, missing: float | None = None) -> Column:
    """Clamped and linear from (low, high) to (0, 1); `missing` for null."""
    v = value.cast("double")
    linear = F.when(v <= low, 0.0).when(v >= high, 1.0).otherwise((v - low) / F.lit(float(high - low)))
    return F.when(v.isNull(), F.lit(missing).cast("double")).otherwise(linear)
