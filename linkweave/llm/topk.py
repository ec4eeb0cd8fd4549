"""Exact top-k search by distributed histogram selection.

Every candidate is scored against a block of queries, but scores are never kept:
a pass only counts them in histograms, one per query, added up over all tasks.
The bin that holds a query's kth score becomes its next range, until the range is
one value. A last pass emits what scores above it, and of what scores just that
the smallest ids, a task at most k a query, so hot vectors cost nothing.

Queries come in blocks, streamed through the driver; what a pass carries and returns
is a block's vectors and histograms, and the block is as large as CARRIED bytes allow.
Within a task, scores exist for PIECE candidates and PIECE queries at a time.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_path, quoted

BINS = 512
CARRIED = 64 << 20
PIECE = 2048


def quantised(column: pa.Array, scale: float, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their floor(scale * x) as float64, shorter vectors
    padded with zeros). Null vectors and those with a null or non-finite
    component take no part."""
    n = len(column)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(n), lengths)
    ok = np.asarray(column.is_valid())
    ok[row[~np.isfinite(flat)]] = False
    starts = np.cumsum(lengths) - lengths
    out = np.zeros((n, max(int(lengths.max(initial=0)), dim or 0)))
    out[row, np.arange(len(flat)) - starts[row]] = np.floor(scale * np.where(np.isfinite(flat), flat, 0))
    return np.flatnonzero(ok), out[ok]


class Scorer:
    """Scores of batches against a block of queries, the query's own rows left out."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, scale: float, exact_float: bool):
        self.ids, self.scale, self.dim = ids, scale, vectors.shape[1]
        self.q = np.ascontiguousarray((vectors if exact_float else vectors.astype(np.int64)).T)
        self.order = np.argsort(ids, kind="stable")

    def batches(self, source):
        """(ids, whether there is one, first query, int64 scores, own (row, query)s) in
        pieces of bounded size; a null id is no query's own."""
        by_id = self.ids[self.order]
        for whole in source:
            for at in range(0, whole.num_rows, PIECE):
                batch = whole.slice(at, PIECE)
                ok, v = quantised(batch.column(1), self.scale, self.dim)
                if not len(ok):
                    continue
                some = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[ok]
                ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)[ok]
                v = v if self.q.dtype == np.float64 else v.astype(np.int64)
                lo, hi = np.searchsorted(by_id, ids), np.searchsorted(by_id, ids, "right")
                own = [(r, int(self.order[j])) for r in np.flatnonzero((hi > lo) & some) for j in range(lo[r], hi[r])]
                for q in range(0, self.q.shape[1], PIECE):
                    yield ids, some, q, v @ self.q[:, q : q + PIECE], [(r, j - q) for r, j in own if q <= j < q + PIECE]


def _bin_width(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-(hi - lo + 1) // BINS))


def _histograms(vectors: DataFrame, scorer: Scorer, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Counts (queries, BINS) of the scores within each query's range."""
    width, nq = _bin_width(lo, hi), len(lo)

    def count(batches):
        total = np.zeros((nq, BINS), np.int64)
        for _, _, q, s, own in scorer.batches(batches):
            these = slice(q, q + s.shape[1])
            b = np.floor_divide(s - lo[these], width[these]).astype(np.int64)
            inside = (s >= lo[these]) & (s <= hi[these])
            for r, j in own:
                inside[r, j] = False
            b += np.arange(s.shape[1]) * BINS
            total[these] += np.bincount(b[inside], minlength=s.shape[1] * BINS).reshape(-1, BINS)
        total = total.ravel()
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = vectors.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(nq * BINS, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(nq, BINS)


def kth_scores(vectors: DataFrame, scorer: Scorer, k: int, bound: np.ndarray) -> np.ndarray:
    """Each query's kth greatest score; the least possible one where there are fewer than k."""
    lo, hi = -bound, bound.copy()
    need = np.full(len(bound), k, np.int64)
    while (lo < hi).any():
        counts = _histograms(vectors, scorer, lo, hi)
        width = _bin_width(lo, hi)
        down = counts[:, ::-1].cumsum(axis=1)
        enough = down >= need[:, None]
        first = np.where(enough.any(axis=1), enough.argmax(axis=1), BINS - 1)
        above = np.where(first > 0, np.take_along_axis(down, np.maximum(first - 1, 0)[:, None], 1)[:, 0], 0)
        b = BINS - 1 - first
        short, single = ~enough.any(axis=1), lo == hi
        new_lo = lo + b * width
        lo, hi = np.where(single | short, lo, new_lo), np.where(short, lo, np.where(single, hi, np.minimum(hi, new_lo + width - 1)))
        need = np.where(single | short, need, need - above)
    return lo


def _best(q: np.ndarray, s: np.ndarray, ids: np.ndarray, some: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best: greatest score, then no id, then smallest id."""
    order = np.lexsort((ids, some, -s, q))
    place = np.arange(len(order)) - np.searchsorted(q[order], q[order])
    return order[place < k]


def _emit(vectors: DataFrame, scorer: Scorer, kth: np.ndarray, k: int) -> DataFrame:
    def keep(batches):
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]  # query, score, id, whether there is one
        for ids, some, q, s, own in scorer.batches(batches):
            hit = s >= kth[q : q + s.shape[1]]
            for r, j in own:
                hit[r, j] = False
            r, j = np.nonzero(hit)
            if len(r):
                held = [np.concatenate(x) for x in zip(held, (q + j, s[r, j].astype(np.int64), ids[r], some[r]), strict=True)]
                best = _best(*held, k)
                held = [x[best] for x in held]
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[2], mask=~held[3]), pa.array(held[1])], ["q", "vec_id", "score"])

    found = vectors.mapInArrow(keep, "q long, vec_id long, score long")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0, block: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of
    vectors with the greatest inner product of floor(scale * x), ties to the
    smaller id, all if there are fewer; exact.

    A query's own row is any row of its id. Rows without an id are no queries; as
    candidates they keep their null vec_id and come before all ids in ties. Null
    vectors and those with a null or non-finite component take no part; shorter ones
    count as padded with zeros. Repeated query rows are answered each, and repeated
    candidates are candidates each. Empty tables: no rows. Other columns, whatever
    their names, are not read. Products that could pass 2**62 raise ValueError.

    block: queries answered in one go; by default as many as CARRIED allows."""
    spark = vectors.sparkSession
    two = lambda df: df.select(quoted(id_col).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"))
    both = two(vectors)

    def extent(batches):
        top = norm = 0.0
        dim = 0
        for b in batches:
            _, v = quantised(b.column(1), scale)
            if v.size:
                top, norm, dim = max(top, float(np.abs(v).max())), max(norm, float((v * v).sum(axis=1).max())), max(dim, v.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array([top]), pa.array([norm]), pa.array([dim], pa.int64())], ["top", "norm", "dim"])

    extents = both.mapInArrow(extent, "top double, norm double, dim long").agg(F.max("top"), F.max("norm"), F.max("dim")).first()
    top, norm, dim = (x or 0 for x in extents)
    block = block or max(256, CARRIED // (8 * (dim + BINS)))
    out = new_path(spark, "topk")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(out)
    stream = two(queries).where("id is not null").toLocalIterator()
    while rows := list(islice(stream, block)):
        ok, v = quantised(pa.array([r.v for r in rows], pa.list_(pa.float64())), scale, dim)
        if not len(ok):
            continue
        v = v if v.shape[1] >= dim else np.pad(v, ((0, 0), (0, dim - v.shape[1])))
        most = max(float(np.abs(v).max(initial=0)), top)
        wide = most * most * max(v.shape[1], 1)
        if not wide < 2.0**62:
            raise ValueError("scores do not fit a long")
        ids = np.array([rows[i].id for i in ok], np.int64)
        scorer = Scorer(ids, v, scale, wide < 2.0**53)
        bound = (np.sqrt((v * v).sum(axis=1) * norm) * (1 + 1e-9)).astype(np.int64) + 1
        found = _emit(both, scorer, kth_scores(both, scorer, k, bound), k)
        names = spark.createDataFrame(pa.table({"q": np.arange(len(ids)), "query_id": ids}))
        found.join(F.broadcast(names), "q").select("query_id", F.col("rank").cast("int"), "vec_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)
