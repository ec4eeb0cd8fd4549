"""Candidate pairs by index keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.plans.lineage import staged

ALL = "*"
#: Records of a block that meet in one task; larger blocks are cut.
SPLIT = 4096
#: Parts that a block is cut in at most, as a record goes to a task for each.
PARTS = 32
#: Records of the same keys and values that stand in one row, about.
BUNDLE = 256
#: Pairs that a task of the join makes, at least (where there are tasks enough) and at most, and the most tasks.
TASK_LEAST, TASK_MOST, MOST_TASKS = 1 << 12, 1 << 22, 4096


@dataclass(frozen=True)
class Blocking:
    """An index: records that share a key are candidates.

    keys: function of a DataFrame to a column, a value or an array of values.
    kind 'all_pairs' compares everything, as one block. strict: null and '' keys
    are errors; else they are left out."""

    name: str
    keys: Callable[[DataFrame], Column] | None = None
    kind: str = "block"
    strict: bool = True

    def __post_init__(self):
        if not isinstance(self.name, str) or not self.name:
            raise TypeError("an index needs a name")
        if self.kind not in ("block", "all_pairs"):
            raise TypeError(f"not a kind of index: {self.kind!r}")
        if self.kind == "block" and not callable(self.keys):
            raise TypeError(f"the keys of index {self.name} are not a function")

    def many(self, df: DataFrame) -> bool:
        """Whether the keys of a record are a list."""
        return self.kind == "block" and df.select(self.keys(df).alias("k")).schema["k"].dataType.typeName() == "array"

    def key_list(self, df: DataFrame) -> Column:
        """array<string> of the record's keys."""
        if self.kind == "all_pairs":
            return F.array(F.lit(ALL))
        keys = self.keys(df)
        kind = df.select(keys.alias("k")).schema["k"].dataType
        keys = F.transform(keys, lambda k: k.cast("string")) if kind.typeName() == "array" else F.array(keys.cast("string"))
        if not self.strict:
            return F.filter(keys, lambda k: k.isNotNull() & (k != ""))
        bad = F.exists(keys, lambda k: F.coalesce(k == "", F.lit(True)))
        return F.when(bad, F.raise_error(F.lit(f"index {self.name}: empty key")).cast("array<string>")).otherwise(keys)


def index(df: DataFrame, blockings: list[Blocking], id_col: str) -> DataFrame:
    """(index_name, key, id): the indices' contents, a row per key of a record."""
    lists = F.array(*(F.struct(F.lit(b.name).alias("index_name"), b.key_list(df).alias("keys")) for b in blockings))
    x = df.select(F.col(id_col).alias("id"), F.explode(lists).alias("i"))
    return x.select("i.index_name", F.explode("i.keys").alias("key"), "id")


def bundles(df: DataFrame, blockings: list[Blocking], id_col: str, value: Column | None = None, member: Column | None = None) -> DataFrame:
    """(keys, v, ids, least, most): records of the same keys and value, about BUNDLE at
    most in a row, so that what depends on them alone is computed once. The indices
    give one key each, null where there is none. ids: with `member`, structs of id and m."""
    first = F.array(*(F.get(b.key_list(df), F.lit(0)) for b in blockings))
    x = df.select(first.alias("keys"), (F.lit(0) if value is None else value).alias("v"), F.col(id_col).alias("id"), *([] if member is None else [member.alias("m")]))
    x = x.where(F.exists("keys", lambda k: k.isNotNull())).withColumn("same", F.xxhash64("keys", "v"))
    many = x.groupBy("same").count().where(F.col("count") > BUNDLE)
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("count") / F.lit(BUNDLE))), F.lit(0).cast("long"))
    x = x.join(many, "same", "left").withColumn("part", part)
    ids = F.col("id") if member is None else F.struct("id", "m")
    return x.groupBy("keys", "v", "part").agg(F.collect_list(ids).alias("ids"), F.min("id").alias("least"), F.max("id").alias("most")).drop("part")


def _singles(df: DataFrame, blockings: list[Blocking]) -> DataFrame:
    """Rows of `index`, each a bundle of its own: for indices of several keys a record."""
    x = index(df, blockings, "id")
    return x.select(F.col("index_name").alias("i"), "key", F.lit(0).alias("v"), F.array("id").alias("ids"), F.col("id").alias("least"), F.col("id").alias("most"), F.array().cast("array<string>").alias("keys"))


def _meet(left: DataFrame, right: DataFrame | None, split: int | None, within: bool, earlier: int = 0) -> DataFrame:
    """Joins bundles (i, key, keys, v, ids, least, most) that share a key. Nothing is
    shuffled but the bundles: blocks of more than `split` records are cut in up to PARTS
    parts, of which each meets each in a cell of its own, and the tasks are as many as
    the pairs need, not as the bundles do. Of the keys that two bundles share, one of the first
    `earlier` indices counts only if no index before it has them meet."""
    on = ["i", "key"]
    spark = left.sparkSession
    count = lambda x, n, m: x.select(*on, (F.size("ids") * n).alias("n"), (F.size("ids") * m).alias("m"))
    rows = count(left, 1, 1) if right is None else count(left, 1, 0).unionAll(count(right, 0, 1))
    sizes = rows.groupBy(*on).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).where("n > 0 and m > 0")
    size = F.col("n") if right is None else F.col("n") + F.col("m")
    work, largest = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m")), F.max(size)).first()
    work = work or 0.0
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = int(min(MOST_TASKS, max(min(usual, work // TASK_LEAST + 1), work // TASK_MOST + 1)))
    parts = None
    if split and (largest or 0) > split:
        parts = sizes.where(size > split).select(*on, F.least(F.ceil(size / F.lit(split)), F.lit(PARTS)).alias("parts"))
    columns = ["keys", "v", "ids", "least", "most"]

    def side(x: DataFrame, prefix: str, mine: str, other: str) -> DataFrame:
        if parts is None:
            x = x.withColumns({mine: F.lit(0), other: F.lit(0)})
        else:
            x = x.join(parts, on, "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
            x = x.withColumn(mine, F.pmod(F.xxhash64("least", F.lit(1)), "parts").cast("int"))
            x = x.withColumn(other, F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
        x = x.select(*on, "row", "column", *(F.col(c).alias(f"{prefix}_{c}") for c in columns))
        return x.repartition(tasks, *on, "row", "column")

    x = side(left, "a", "row", "column").join(side(left if right is None else right, "b", "column", "row").hint("merge"), [*on, "row", "column"])
    if within:
        x = x.where("a_least < b_most")
    for j in range(earlier - 1):
        x = x.where(~F.coalesce((F.col("i") > j) & (F.col("a_keys")[j] == F.col("b_keys")[j]), F.lit(False)))
    return x.select("a_ids", "b_ids", "a_v", "b_v")


def one_key(blockings: list[Blocking], df: DataFrame) -> bool:
    """Whether each index gives a record one key at most."""
    return len({b.name for b in blockings}) == len(blockings) and not any(b.many(df) for b in blockings)


def meet(left: DataFrame, blockings: list[Blocking], id_col: str, right: DataFrame | None = None, right_blockings: list[Blocking] | None = None, split: int | None = SPLIT, values: tuple[Column | None, Column | None] = (None, None), members: tuple[Column | None, Column | None] = (None, None), once: bool = True) -> DataFrame:
    """(a_ids, b_ids, a_v, b_v): bundles whose records are candidates, for indices
    of one key a record (`one_key`); `pairs` gives the pairs. Within left, where
    a_id < b_id. Not once: for each shared key."""
    theirs = right_blockings or blockings
    if right is not None:
        _same_kinds(blockings, theirs)
        n = min(len(blockings), len(theirs))
        blockings, theirs = blockings[:n], theirs[:n]

    def rows(df: DataFrame, bs: list[Blocking], side: int) -> DataFrame:
        x = staged(bundles(df, bs, id_col, values[side], members[side]), "bundles")
        return x.select("*", F.posexplode("keys").alias("i", "key")).where("key is not null")

    a = rows(left, blockings, 0)
    b = None if right is None else rows(right, theirs, 1)
    return _meet(a, b, split, right is None, len(blockings) if once else 0)


def pairs(met: DataFrame, within: bool, *columns: str) -> DataFrame:
    """(a_id, b_id, *columns): the pairs of bundles that met; `columns` are the bundles'.
    Bundles with members give a_id and b_id as structs of id and m."""
    x = met.select(F.explode("a_ids").alias("a_id"), "b_ids", *columns).select("a_id", F.explode("b_ids").alias("b_id"), *columns)
    if not within:
        return x
    plain = "m" not in getattr(x.schema["a_id"].dataType, "names", [])
    return x.where("a_id < b_id" if plain else "a_id.id < b_id.id")


def count_pairs(a: Column, b: Column) -> Column:
    """How many pairs a < b two arrays of ids have: a walk over both in order."""
    merged = F.sort_array(F.concat(F.transform(a, lambda v: F.struct(v.alias("v"), F.lit(1).alias("side"))), F.transform(b, lambda v: F.struct(v.alias("v"), F.lit(0).alias("side")))))
    step = lambda s, e: F.struct((s["a"] + e["side"]).alias("a"), F.when(e["side"] == 0, s["n"] + s["a"]).otherwise(s["n"]).alias("n"))
    walked = F.aggregate(merged, F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("n")), step, lambda s: s["n"])
    product = F.size(a).cast("long") * F.size(b)
    return F.when(F.array_max(a) < F.array_min(b), product).otherwise(walked)


def spanning(met: DataFrame, within: bool) -> DataFrame:
    """(a_id, b_id): of the pairs of two bundles, as many as connect all records that
    have one: all with the last of b or the first of a. For groups, not for lists of pairs."""
    x = met.select(F.array_min("a_ids").alias("a"), F.array_max("b_ids").alias("b"), "a_ids", "b_ids")
    if within:
        x = x.where("a < b").withColumns({"a_ids": F.filter("a_ids", lambda v: v < F.col("b")), "b_ids": F.filter("b_ids", lambda v: v > F.col("a"))})
    edge = lambda u, v: F.struct(u.alias("a_id"), v.alias("b_id"))
    edges = F.concat(F.transform("a_ids", lambda v: edge(v, F.col("b"))), F.transform("b_ids", lambda v: edge(F.col("a"), v)))
    return x.select(F.explode(edges).alias("e")).select("e.a_id", "e.b_id")


def _same_kinds(blockings: list[Blocking], theirs: list[Blocking]) -> None:
    for a, b in zip(blockings, theirs, strict=False):
        if a.kind != b.kind:
            raise TypeError(f"indices {a.name} and {b.name} are of different kinds")


def _repeats(df: DataFrame, id_col: str) -> bool:
    return not df.groupBy(F.col(id_col)).count().where("count > 1").isEmpty()


def candidates(left: DataFrame, blockings: list[Blocking], id_col: str, right: DataFrame | None = None, right_blockings: list[Blocking] | None = None, split: int | None = SPLIT) -> DataFrame:
    """Distinct (a_id, b_id): within left, each unordered pair once with the lesser
    id first; or left to right, indices matched by position. Where a record may have several
    keys of an index, or an id several records, pairs are made for each and repeated
    ones dropped, by a shuffle of all; else no pair is shuffled."""
    theirs = right_blockings or blockings
    if one_key(blockings, left) and (right is None or one_key(theirs, right)):
        x = pairs(meet(left, blockings, id_col, right, right_blockings, split), right is None)
        return x.distinct() if _repeats(left, id_col) or (right is not None and _repeats(right, id_col)) else x
    return shared_keys(left, blockings, id_col, right, theirs, split).distinct()


def shared_keys(left: DataFrame, blockings: list[Blocking], id_col: str, right: DataFrame | None = None, right_blockings: list[Blocking] | None = None, split: int | None = SPLIT) -> DataFrame:
    """(a_id, b_id): candidates, once for each key that they share."""
    theirs = right_blockings or blockings
    named = lambda df: df.withColumn("id", F.col(id_col)) if id_col != "id" else df
    if right is None:
        met = _meet(_singles(named(left), blockings), None, split, True)
    else:
        _same_kinds(blockings, theirs)
        n = min(len(blockings), len(theirs))
        number = lambda bs: [Blocking(str(i), b.keys, b.kind, b.strict) for i, b in enumerate(bs[:n])]
        met = _meet(_singles(named(left), number(blockings)), _singles(named(right), number(theirs)), split, False)
    return pairs(met, right is None)


def all_pairs_within(df: DataFrame, id_col: str, split: int | None = SPLIT) -> DataFrame:
    return candidates(df, [Blocking("all", kind="all_pairs")], id_col, split=split)


def all_pairs_between(left: DataFrame, right: DataFrame, id_col: str, split: int | None = SPLIT) -> DataFrame:
    return candidates(left, [Blocking("all", kind="all_pairs")], id_col, right, split=split)


def search(probe: DataFrame, table: DataFrame, blocking: Blocking, id_col: str) -> DataFrame:
    """(probe_id, id): the table's records that share a key with a probe, once for
    each shared key."""
    if not blocking.many(probe) and not blocking.many(table):
        return pairs(meet(probe, [blocking], id_col, table), False).toDF("probe_id", "id")
    a = index(probe, [blocking], id_col).withColumnRenamed("id", "probe_id")
    return a.join(index(table, [blocking], id_col), ["index_name", "key"]).select("probe_id", "id")


def block_lists(df: DataFrame, blocking: Blocking, id_col: str) -> DataFrame:
    """(key, ids): posting lists, for reports on small tables."""
    return index(df, [blocking], id_col).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def block_sizes(ix: DataFrame) -> DataFrame:
    return ix.groupBy("index_name", "key").agg(F.count("*").alias("n"))


def count_self(ix: DataFrame) -> DataFrame:
    """(index_name, comparisons): upper bound of a self comparison."""
    return block_sizes(ix).groupBy("index_name").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("comparisons"))


def count_between(ix: DataFrame, other: DataFrame) -> DataFrame:
    b = block_sizes(other).withColumnRenamed("n", "m")
    return block_sizes(ix).join(b, ["index_name", "key"]).groupBy("index_name").agg(F.sum(F.col("n") * F.col("m")).alias("comparisons"))


def all_pairs_count(df: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """comparisons made; upper_bound is the figure reported for a self comparison,
    which counts each record with itself."""
    if other is None:
        return df.agg(F.count("*").alias("n")).select(F.expr("n * (n - 1) div 2").alias("comparisons"), F.expr("n * (n + 1) div 2").alias("upper_bound"))
    sides = df.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(other.select(F.lit(0), F.lit(1)))
    return sides.agg((F.coalesce(F.sum("l"), F.lit(0)) * F.coalesce(F.sum("r"), F.lit(0))).alias("comparisons")).withColumn("upper_bound", F.col("comparisons"))


def block_stats(ix: DataFrame) -> DataFrame:
    """(index_name, records, blocks, largest, average)"""
    return block_sizes(ix).groupBy("index_name").agg(F.sum("n").alias("records"), F.count("*").alias("blocks"), F.max("n").alias("largest"), F.round(F.avg("n"), 2).alias("average"))


def explain_blocking(ix: DataFrame, other: DataFrame | None = None) -> DataFrame:
    """What the comparisons will cost, before the work starts."""
    counts = count_self(ix) if other is None else count_between(ix, other)
    return block_stats(ix).join(counts, "index_name", "left").na.fill(0, ["comparisons"])
