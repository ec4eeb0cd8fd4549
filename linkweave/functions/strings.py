"""Edit distances (E13-E17) and Arrow UDFs for what Spark lacks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def levenshtein_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of strings, in code points; null if either is null."""
    return F.levenshtein(a, b)


def _similarity(a: Column, b: Column, distance: Column) -> Column:
    none = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(~none, 1.0 - distance / F.greatest(F.length(a), F.length(b)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; null if either is null or ''."""
    return _similarity(a, b, F.levenshtein(a, b))


def osa(a: Sequence, b: Sequence) -> int:
    """Edit distance with adjacent transpositions and no second edit of a part
    (optimal string alignment), three rows at a time."""
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        before, row = row, now
    return row[-1]


def levenshtein(a: Sequence, b: Sequence) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def _codes(items: list[Sequence], fill: int, codes: dict) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as rows of numbers, filled up, and their lengths."""
    lengths = np.array(list(map(len, items)), np.int64)
    out = np.full((len(items), int(lengths.max(initial=0))), fill, np.int64)
    for i, x in enumerate(items):
        out[i, : len(x)] = [codes.setdefault(v, len(codes)) for v in x]
    return out, lengths


def edit_distances(a: list[Sequence], b: list[Sequence], transpositions: bool) -> np.ndarray:
    """Distances of many pairs, a matrix row of all of them at a time: what an insertion
    adds along a row is a running minimum. With transpositions as `osa`, else as `levenshtein`."""
    codes: dict = {}
    (x, nx), (y, ny) = _codes(a, -1, codes), _codes(b, -2, codes)
    place = np.arange(y.shape[1] + 1)
    row, before, out = np.tile(place, (len(a), 1)), None, ny.copy()
    for i in range(1, x.shape[1] + 1):
        now = np.empty_like(row)
        now[:, 0] = i
        letter = x[:, i - 1, None]
        now[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (letter != y))
        if transpositions and i > 1 and y.shape[1] > 1:
            swapped = (letter == y[:, :-1]) & (x[:, i - 2, None] == y[:, 1:])
            now[:, 2:] = np.where(swapped, np.minimum(now[:, 2:], before[:, :-2] + 1), now[:, 2:])
        now = np.minimum.accumulate(now - place, axis=1) + place
        done = np.flatnonzero(nx == i)
        out[done] = now[done, ny[done]]
        before, row = row, now
    return out


def _distance(a: Column, b: Column, transpositions: bool) -> Column:
    @F.arrow_udf("bigint")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        x, y = left.to_pylist(), right.to_pylist()
        some = [i for i, (u, v) in enumerate(zip(x, y, strict=True)) if u is not None and v is not None]
        some.sort(key=lambda i: (len(x[i]), len(y[i])))  # matrices of about one size together
        out = np.zeros(len(x), np.int64)
        at = 0
        while at < len(some):
            width = max(len(x[some[at]]), len(y[some[at]])) + 1
            these = some[at : at + max(1, (1 << 18) // width)]
            out[these] = edit_distances([x[i] for i in these], [y[i] for i in these], transpositions)
            at += len(these)
        none = np.ones(len(x), bool)
        none[some] = False
        return pa.array(out, mask=none)

    return of(a, b)


def lift(f: Callable, returns: str = "double") -> Callable[..., Column]:
    """A Python function of two values as a function of two columns, in Arrow
    batches; null where either is null."""

    @F.arrow_udf(returns)
    def of(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)])

    return of


def osa_distance(a: Column, b: Column) -> Column:
    """Of strings or arrays; null if either is null."""
    return _distance(a, b, True)


def sequence_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of arrays."""
    return _distance(a, b, False)


def osa_similarity(a: Column, b: Column) -> Column:
    return _similarity(a, b, osa_distance(a, b))


def python_comparator(f: Callable) -> Callable[[Column, Column], Column]:
    return lift(f)


if __name__ == "__main__":  # distance of two arguments
    import sys

    print(osa(sys.argv[1], sys.argv[2]) if len(sys.argv) < 4 else levenshtein(sys.argv[1], sys.argv[2]))
