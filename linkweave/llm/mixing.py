"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected `target / source size` times. The expected
copies are summed along the source, one offset in [0, 1) is added, and a document
is emitted once for each integer that its stretch of the sum crosses. Along a
source, documents stand in order of size, so that the sample is even over sizes
and the words taken stay within a few of the largest documents of the target.

The order is global, yet no source is ever in one task: rows (ids and sizes only)
are range-partitioned by (source, size, id), counted by (partition, source), and
numbered within a partition from the counts before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fingerprints, free_name, n_words, partitions, quoted, staged


def source_key(source: Column) -> Column:
    """Null and the text 'null' are different sources."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source, from 52 bits of an MD5: every rerun,
    and every engine, gets the same."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), source_key(source)).cast("binary")), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16**13))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, weigh `weights` in turn and share the
    sum of all sizes; a target stops at `most` times its source's size and the
    excess is shared again by weight until none is above. That fixed point is
    min(most * size, level * weight): the level is found from prefix sums in the
    order of most * size / weight. Over one row per source, never over documents."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = (F.lit(most) * F.col("source_size")).cast("double")
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    x = sizes.withColumn("w", w.cast("double")).withColumn("cap", cap).withColumn("fill", F.col("cap") / F.col("w"))
    x = x.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
    x = x.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    x = x.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(everything))
    return x.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def systematic(sized: DataFrame, seed: int = 20, then: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target) with `copies` (long): how often
    each row is taken. sized must be a written table: it is read twice.

    Rows that tie in (source, size, doc_id) stand in order of the columns `then`; those
    that tie in all are alike, and so are exchangeable."""
    order = ["size", "doc_id", *then]
    pids = sized.repartitionByRange(partitions(sized), F.col("source").asc_nulls_last(), *order)
    placed = staged(pids.withColumn("_pid", F.spark_partition_id()), "mix-placed")
    counts = placed.groupBy("_pid", "source").agg(F.count("*").alias("_n"))
    along = Window.partitionBy("source").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_pid").alias("_p"), source_key(F.col("source")).alias("_s"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_pid", "_s").orderBy(*order)
    x = placed.withColumn("_s", source_key(F.col("source")))
    x = x.join(starts.withColumnRenamed("_p", "_pid"), ["_pid", "_s"])
    x = x.withColumn("_i", F.col("_start") + F.row_number().over(within) - 1)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor(u + rate * (F.col("_i") + 1)) - F.floor(u + rate * F.col("_i"))
    return x.withColumn("copies", copies.cast("long")).drop("_pid", "_s", "_start", "_i")


def _mixed(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20, then: tuple[str, ...] = ()) -> DataFrame:
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    key = source_key(F.col("source"))
    by = sources.select(key.alias("_s"), "source_size", "target")
    return systematic(staged(sized.withColumn("_s", key).join(by, "_s").drop("_s"), "mix-targets"), seed, then)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20) -> DataFrame:
    """For each row of docs (doc_id, text, source): doc_id, source, size,
    source_size, target, copies.

    Size is the number of words of the whole text (null and empty texts: 0; a source
    of such texts has target 0 and is not taken). Null ids and sources are values like
    any other; repeated rows count each; rows that tie in source, size and id are
    exchangeable. Other columns, whatever their names, are not read. Empty table: no
    rows."""
    sized = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sized")
    return _mixed(sized, weights, most, seed)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs
    whatever their names. Options as of `mix`.

    Rows are known by 128 bits of a hash of all their columns, which also orders those
    that tie in source, size and id: reruns and other partitions give the same rows.
    Repeated rows are exchangeable; what the mix takes of them is emitted from one,
    found by an aggregation that combines before the shuffle. Null and empty texts
    have size 0 and are taken like others where their source is. Empty table: no rows."""
    high, low, copies = (free_name(docs, x) for x in ("row_high", "row_low", "row_copies"))
    a, b = fingerprints(docs)
    sized = staged(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), a.alias("high"), b.alias("low")), "mix-sized")
    taken = _mixed(sized, **options, then=("high", "low"))
    taken = taken.groupBy("high", "low").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    taken = staged(taken, "mix-taken")
    x = docs.withColumns({high: a, low: b})
    if not taken.where("n > 1").isEmpty():
        x = x.dropDuplicates([high, low])
    x = x.join(taken.where("copies > 0").select(F.col("high").alias(high), F.col("low").alias(low), F.col("copies").alias(copies)), [high, low])
    rows = [quoted(c) for c in docs.columns]
    return x.select(*rows, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copies)).select(rows)
