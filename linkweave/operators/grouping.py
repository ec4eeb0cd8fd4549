"""Groups of matching records: adjacency, connected components, singles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.plans.lineage import Scratch, staged


def adjacency_list(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, neighbours): undirected, duplicates and self-loops kept, sorted.

    For reports; the operators below never collect a node's neighbours."""
    both = edges.select(F.col(src).alias("node"), F.col(dst).alias("n")).unionAll(edges.select(F.col(dst).alias("node"), F.col(src).alias("n")))
    return both.groupBy("node").agg(F.array_sort(F.collect_list("n")).alias("neighbours"))


def bundle_adjacency(met: DataFrame) -> DataFrame:
    """(node, neighbours) of the pairs a_id < b_id of bundles (a_ids, b_ids), sorted: what
    adjacency_list gives for them, but a node's neighbours of a bundle are shuffled as one list."""
    a = met.select(F.explode("a_ids").alias("node"), F.col("b_ids").alias("n")).select("node", F.filter("n", lambda v: v > F.col("node")).alias("n"))
    b = met.select(F.explode("b_ids").alias("node"), F.col("a_ids").alias("n")).select("node", F.filter("n", lambda v: v < F.col("node")).alias("n"))
    return a.unionAll(b).where("size(n) > 0").groupBy("node").agg(F.sort_array(F.flatten(F.collect_list("n"))).alias("neighbours"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above u is tied to the least of u and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and each neighbour below it are tied to the least of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the least node that can be reached.

    Alternating large-star and small-star (Kiveris et al., 2014): O(log^2 n) rounds,
    each of a few aggregations and joins; a hub's edges meet only the hub's
    aggregated minimum. Every round is written to the shared folder, and removed after
    the next. Edges with a null end are ignored; a self-loop alone makes a component
    of one."""
    spark = edges.sparkSession
    with Scratch(spark) as ends, Scratch(spark) as old:
        e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
        e = ends.staged(e, "cc-edges")
        loops = e.where("u = v").select(F.col("u").alias("node"))
        nodes = old.staged(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        state = None
        while True:
            now = nodes.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == state or not now[0]:
                break
            state = now
            new = Scratch(spark)
            nodes = new.staged(_small_star(_large_star(nodes)), "cc")
            old.drop()
            old.paths = new.paths
        stars = nodes.select(F.col("u").alias("node"), F.col("v").alias("component"))
        roots = nodes.select(F.col("v").alias("node")).unionAll(loops.join(stars.select("node"), "node", "left_anti")).distinct()
        return staged(stars.unionByName(roots.select("node", F.col("node").alias("component"))), "components")


def singles_and_groups(matches: DataFrame, records: DataFrame, id_col: str, a: str = "a_id", b: str = "b_id") -> DataFrame:
    """records with `component`: the group's least id; null for a single."""
    labels = connected_components(matches, a, b).withColumnRenamed("node", id_col)
    return records.join(labels, id_col, "left")


def group_ids(grouped: DataFrame) -> DataFrame:
    """grouped (with `component`) with group_id 0.. in order of the least id; null for
    singles. Numbers one row per group, not the records: groups are dealt to ranges
    of their ids, and numbered within a range after those of the ranges before it,
    whose counts alone meet in one task."""
    spark = grouped.sparkSession
    ids = grouped.where("component is not null").select("component").distinct()
    ids = ids.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "component").withColumn("_range", F.spark_partition_id())
    ids = staged(ids, "groups")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ids.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("component"))
    ids = ids.join(F.broadcast(starts), "_range").select("component", (F.col("_start") + within - 1).alias("group_id"))
    return grouped.join(ids, "component", "left")
