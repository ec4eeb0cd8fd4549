"""Near copies of whole texts: windows of words, rare ones first, as blocking keys.

Texts whose sets of windows have a Jaccard similarity of t or more share one of
the first n - ceil(t * n) + 1 windows of each, in any one order of all windows. The
order is by how often the window's bucket occurs, so blocks stay small.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.operators import blocking

#: Windows are counted by their lowest bits. Only the order of keys depends on it.
BUCKETS = 1 << 20


def window_set(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted 64-bit hashes of the runs of `width` words of a text, all of it; of
    the whole text if it has fewer words."""
    words = text.split(" ") if text else []
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - min(width, len(h)) + 1 if len(h) else 0
    with np.errstate(over="ignore"):
        out = np.full(n, min(width, len(h)), np.uint64)
        for i in range(min(width, len(h))):
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : n + i]
        return np.unique((out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB))


def window_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How many texts have a window of each bucket (those that share one count more)."""

    def count(batches):
        n = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                np.add.at(n, (window_set(x) % np.uint64(BUCKETS)).astype(np.int64), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["bucket", "n"])

    got = texts.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def first_windows(windows: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    n = len(windows)
    if not n:
        return windows
    order = np.lexsort((windows, counts[(windows % np.uint64(BUCKETS)).astype(np.int64)]))
    return windows[order[: n - math.ceil(least * n) + 1]]


def rare_windows(text: Column, counts, least: float) -> Column:
    """struct (n, keys): how many windows a text has, and keys, one at least of which texts
    of similarity `least` or more share. counts: a broadcast of window_counts."""

    @F.arrow_udf("struct<n:bigint,keys:array<bigint>>")
    def of(texts: pa.Array) -> pa.Array:
        sets = [window_set(x) for x in texts.to_pylist()]
        keys = [first_windows(x, counts.value, least).view(np.int64) for x in sets]
        return pa.StructArray.from_arrays([pa.array(list(map(len, sets)), pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["n", "keys"])

    return of(text)


def shared_keys(texts: DataFrame, counts, least: float, id_col: str, text: str = "text") -> DataFrame:
    """(id_col, n, keys): the keys of rare_windows that two texts or more have. Most
    windows occur once; they are dropped before blocks are made."""
    x = texts.select(id_col, rare_windows(F.col(text), counts, least).alias("w")).select(id_col, "w.n", F.explode("w.keys").alias("key"))
    rows = x.groupBy("key").agg(F.min(id_col).alias("x"), F.max(id_col).alias("y")).where("x <> y").select("key")
    return x.join(rows, "key").groupBy(id_col, "n").agg(F.collect_list("key").alias("keys"))


def near_candidates(keys: DataFrame, least: float, id_col: str, split: int | None) -> DataFrame:
    """(a_id, b_id): of the texts that share a key, those that can be as similar as
    `least`. Of what two texts share, all up to where the keys of either end (n - ceil(least * n)
    + 1 of them, in one order of all windows) is among the keys of both, so they share
    no more than the keys they share and the rest of that one's windows."""
    met = blocking.shared_keys(keys, [blocking.Blocking("windows", lambda d: F.col("keys"), strict=False)], id_col, split=split)
    x = met.groupBy("a_id", "b_id").count()
    for p in "ab":
        rest = (F.ceil(F.col("n") * F.lit(least)) - 1).alias(f"{p}_rest")
        x = x.join(keys.select(F.col(id_col).alias(f"{p}_id"), F.col("n").alias(f"{p}_n"), rest), f"{p}_id")
    most = F.least(F.col("count") + F.greatest("a_rest", "b_rest"), F.col("a_n"), F.col("b_n"))
    return x.where(most + 1e-6 >= (F.col("a_n") + F.col("b_n")) * F.lit(least / (1 + least))).select("a_id", "b_id").distinct()


def window_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the windows of two whole texts."""

    @F.arrow_udf("double")
    def of(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True):
            if not x or not y:
                out.append(None)
                continue
            x, y = window_set(x), window_set(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / (len(x) + len(y) - both))
        return pa.array(out, pa.float64())

    return of(a, b)
