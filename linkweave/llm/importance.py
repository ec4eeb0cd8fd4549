"""Quality classifier: data selection by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: one of all
raw text, one of target text (rows labelled good and not toxic, a bounded sample of them). A
document's importance is the log of the ratio of its likelihoods; adding Gumbel
noise to the logs and taking the k greatest keys samples k documents without
replacement in proportion to importance (Gumbel top-k).

One pass counts, one pass scores. The kth key is located by refining histograms
of the keys, so nothing is sorted and only bins reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mixed, raw_texts, shingle_hashes, slices, staged, tidy, word_hashes

#: Keys are compared as whole multiples of 2**-20.
KEY_UNIT = 1 << 20


@dataclass(frozen=True)
class Sampling:
    """buckets: of the hashed n-grams. max_target: labelled rows of the target
    model at most, in order of a hash of their id; all raw text is counted
    whatever its size. keep: share of the documents to select, by default the
    share of target rows (see is_target) among the labelled ones."""

    buckets: int = 1 << 14
    max_target: int = 20_000
    keep: float | None = None
    seed: int = 3


def ngram_buckets(raw: bytes, buckets: int) -> np.ndarray:
    h = word_hashes(raw.lower())
    pairs = shingle_hashes(h, 2) if len(h) > 1 else h[:0]
    return (np.concatenate([mixed(h), pairs]) % np.uint64(buckets)).astype(np.int64)


def is_target() -> Column:
    """What the target model and the share to keep both count: quality 1 and not toxic."""
    return (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1)


def fit(docs: DataFrame, labels: DataFrame, how: Sampling = Sampling()) -> np.ndarray:
    """log p_target - log p_raw of each bucket. docs: doc_id, text; labels: doc_id,
    quality, toxic. Target: see is_target. The target model is drawn
    towards the raw one by as many counts as there are buckets, so that little
    target text, or none, gives ratios near 1."""
    good = labels.where(F.col("doc_id").isNotNull() & is_target()).select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id", F.lit(how.seed)), "doc_id").limit(how.max_target)
    rows = docs.select("doc_id", "text").join(F.broadcast(good.withColumn("_target", F.lit(True))), "doc_id", "left").select("text", F.coalesce("_target", F.lit(False)))
    n = how.buckets

    def count(batches):
        every, target = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            for part in slices(b):
                for raw, is_target in zip(raw_texts(part.column(0)), part.column(1).to_pylist(), strict=True):
                    c = np.bincount(ngram_buckets(raw or b"", n), minlength=n)
                    every += c
                    if is_target:
                        target += c
            tidy()
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(target[at])], ["bucket", "every", "target"])

    got = rows.mapInArrow(count, "bucket long, every long, target long").groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("target").alias("target")).toArrow()
    every, target = np.ones(n), np.zeros(n)
    every[got.column("bucket").to_numpy()] += got.column("every").to_numpy()
    target[got.column("bucket").to_numpy()] = got.column("target").to_numpy()
    p = every / every.sum()
    return np.log((target + n * p) / (target.sum() + n)) - np.log(p)


def keys(doc_id: Column, text: Column, table: np.ndarray, how: Sampling = Sampling()) -> Column:
    """Struct log_ratio (double), key (long: log ratio plus Gumbel noise, in
    KEY_UNITs). The noise depends on doc_id and seed alone. Null and empty texts:
    log_ratio 0."""

    @F.arrow_udf("struct<log_ratio:double,key:bigint>")
    def of(ids: pa.Array, texts: pa.Array) -> pa.Array:
        score = np.array([table[ngram_buckets(x or b"", how.buckets)].sum() for part in slices(texts) for x in raw_texts(part)])
        tidy()
        h = np.array([xxhash.xxh3_64_intdigest(f"{how.seed}:{i}".encode()) for i in ids.to_pylist()], np.uint64)
        u = ((h >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52
        key = np.floor((score - np.log(-np.log(u))) * KEY_UNIT).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(score), pa.array(key)], ["log_ratio", "key"])

    return of(doc_id, text)


def kth_greatest(df: DataFrame, column: str, k: int, bins: int = 4096) -> tuple[int, int]:
    """(kth greatest value of a long column, how many rows of that value make up
    the k). Histograms over ever smaller ranges; at most `bins` rows reach the driver."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    need = k
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)
        at = F.floor((F.col(column) - F.lit(lo)) / F.lit(width)) if width == 1 else F.expr(f"({column} - {lo}L) div {width}L")
        rows = dict(df.where(F.col(column).between(lo, hi)).groupBy(at.cast("long").alias("b")).count().collect())
        for b in sorted(rows, reverse=True):
            if rows[b] >= need:
                break
            need -= rows[b]
        lo, hi = lo + b * width, min(hi, lo + b * width + width - 1)
    return lo, need


def threshold(scored: DataFrame, k: int) -> tuple[int, int | None]:
    """(key, doc_id): rows of a greater key are in, and of that key those of a
    doc_id up to that one. scored: doc_id (a whole number), key; k of its rows or fewer."""
    key, need = kth_greatest(scored, "key", k)
    tied = scored.where(F.col("key") == key).select((-F.coalesce("doc_id", F.lit(-1))).alias("d"))
    if tied.count() <= need:
        return key, None
    return key, -kth_greatest(tied, "d", need)[0]


def above(key: Column, doc_id: Column, cut: tuple[int, int | None]) -> Column:
    if cut[1] is None:
        return key >= F.lit(cut[0])
    return (key > F.lit(cut[0])) | ((key == F.lit(cut[0])) & (F.coalesce(doc_id, F.lit(-1)) <= F.lit(cut[1])))


def selection(docs: DataFrame, labels: DataFrame, how: Sampling = Sampling()):
    """(scored table, table of log ratios, cut). Rows that repeat a doc_id at the
    cut are in or out together. Without labelled rows, or without documents,
    everything is kept (the cut is None)."""
    table = fit(docs, labels, how)
    scored = staged(docs.select("doc_id", keys(F.col("doc_id"), F.col("text"), table, how).alias("_s")).select("doc_id", "_s.*"), "importance")
    share = how.keep if how.keep is not None else labels.agg(F.avg(is_target().cast("int"))).first()[0]
    n = scored.count()
    k = n if share is None else min(n, int(np.ceil(share * n)))
    return scored, table, threshold(scored, k) if 0 < k < n else None if k else (np.iinfo(np.int64).max, None)


def resample(docs: DataFrame, labels: DataFrame, how: Sampling = Sampling()) -> DataFrame:
    """doc_id, log_ratio, key, kept of every row of docs (doc_id, a whole number or null;
    text). labels: doc_id, quality, toxic.

    Null and empty texts have log_ratio 0 and take part by their noise. Rows of one
    doc_id have one noise; equal keys are told apart by doc_id (a null one counts as -1),
    so rows that repeat both at the cut are in or out together, and as many rows are
    kept as asked or a few more. Labels that are null, repeated, or of no document
    change nothing but the share. Texts are read whole. Other columns, whatever their
    names, are not read. Without labels all rows are kept; empty table: no rows."""
    scored, _, cut = selection(docs, labels, how)
    return scored.withColumn("kept", F.lit(True) if cut is None else above(F.col("key"), F.col("doc_id"), cut))


def selected_documents(docs: DataFrame, labels: DataFrame, how: Sampling = Sampling()) -> DataFrame:
    """The rows of docs that `resample` keeps, with their columns, whatever their names;
    keys are made again, so that texts are not shuffled."""
    _, table, cut = selection(docs, labels, how)
    if cut is None:
        return docs
    return docs.where(above(keys(F.col("doc_id"), F.col("text"), table, how)["key"], F.col("doc_id"), cut))
