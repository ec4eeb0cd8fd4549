"""Pairs made from bundles: against all pairs, and without a shuffle of pairs."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from linkweave.functions import strings
from linkweave.operators import blocking as B
from linkweave.operators import compare as C


def rows(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def people(spark):
    """(id, town, street, name): 600 records of few values, towns and streets null now and then."""
    town = F.when(F.col("id") % 13 != 0, F.concat(F.lit("t"), (F.col("id") % 5).cast("string")))
    street = F.when(F.col("id") % 17 != 0, F.concat(F.lit("s"), (F.col("id") % 11).cast("string")))
    name = F.element_at(F.array(*map(F.lit, ("ann lee", "anna li", "bob ray", "rob roy"))), (F.col("id") * 7 % 4 + 1).cast("int"))
    return spark.range(600).select("id", town.alias("town"), street.alias("street"), name.alias("name"))


BLOCKS = [B.Blocking("town", lambda d: F.col("town"), strict=False), B.Blocking("street", lambda d: F.col("street"), strict=False)]


def brute(people):
    got = people.collect()
    same = lambda x, y: x is not None and x == y
    return [(a, b) for a, b in combinations(got, 2) if same(a.town, b.town) or same(a.street, b.street)]


def test_pairs_of_two_indices_once(people):
    """no pair is shuffled to drop those that two indices give."""
    want = sorted((a.id, b.id) for a, b in brute(people))
    for split in (None, 4096, 8):
        x = B.candidates(people, BLOCKS, "id", split=split)
        assert rows(x) == want
        assert "keys=[a_id" not in plan(x)
    twice = people.unionAll(people)
    assert rows(B.candidates(twice, BLOCKS, "id")) == want
    lists = [B.Blocking("both", lambda d: F.array("town", "street"), strict=False)]
    assert rows(B.candidates(people, lists, "id", split=8)) == want


def test_small_parts_are_few(spark, people):
    """neither side of the join is broadcast by the size that it had before it was copied to its cells."""
    met = B.meet(people, BLOCKS[:1], "id", split=1, values=(F.col("id"), None))
    assert "Broadcast" not in plan(met).split("SortMergeJoin")[0] and "SortMergeJoin" in plan(met)
    assert rows(B.pairs(met, True)) == sorted((a.id, b.id) for a, b in brute(people) if a.town is not None and a.town == b.town)


def test_all_pairs_in_many_tasks(spark):
    """all pairs of one block, in as many tasks as the pairs need."""
    x = spark.range(12_000).withColumn("a", F.lit(0))
    got = B.all_pairs_within(x, "id", split=256)
    assert got.rdd.getNumPartitions() > 30
    n, low, high = got.agg(F.count("*"), F.sum("a_id"), F.sum("b_id")).first()
    assert n == 12_000 * 11_999 // 2 and low + high == 11_999 * (12_000 * 11_999 // 2)
    assert got.where("a_id >= b_id").isEmpty()


def test_between_tables(spark, people):
    """Two tables by one key, without a shuffle of pairs, in many tasks; a search gives a record for each shared key."""
    other = spark.range(40).select("id", F.concat(F.lit("t"), (F.col("id") % 7).cast("string")).alias("town"))
    want = sorted((a.id, b.id) for a in people.collect() for b in other.collect() if a.town == b.town)
    for split in (4096, 8):
        x = B.candidates(people, BLOCKS[:1], "id", other, split=split)
        assert rows(x) == want and "keys=[a_id" not in plan(x)
    assert rows(B.search(people, other.unionAll(other), BLOCKS[0], "id")) == sorted(want * 2)


def test_equal_values_are_compared_once(spark, people):
    """and the similarity is that of the lesser id first."""
    calls = spark.sparkContext.accumulator(0)

    def near(a, b):
        calls.add(1)
        return len(a) + len(b) / 100 + (a < b)

    record = C.Record(("s", C.Field(strings.lift(near), "name")))
    got = rows(record.compare_blocks(people, BLOCKS[:1]).select("a_id", "b_id", "sim.s"))
    assert 0 < calls.value <= 5 * 4 * 4  # towns, and names of either side
    assert got == sorted((a.id, b.id, near(a.name, b.name)) for a, b in brute(people) if a.town is not None and a.town == b.town)
    by_id = record.compare(B.candidates(people, BLOCKS[:1], "id"), people, id_col="id")
    assert rows(by_id.select("a_id", "b_id", "sim.s")) == got


def test_both_fields_of_a_record(people):
    """Records linked with each other by different fields of the two."""
    record = C.Record(("s", C.Field(lambda a, b: (a == b).cast("double"), "town", None, "street", F.upper)))
    got = rows(record.compare_blocks(people, BLOCKS[1:]).select("a_id", "b_id", "sim.s"))
    by_id = record.compare(B.candidates(people, BLOCKS[1:], "id"), people, id_col="id")
    assert got == rows(by_id.select("a_id", "b_id", "sim.s")) and got


def test_spanning_edges_connect_what_pairs_do(people):
    """groups from fewer edges than pairs."""
    from linkweave.operators.grouping import connected_components

    met = C.Record(("s", C.Field(strings.levenshtein_similarity, "name"))).compare_bundles(people, BLOCKS[:1]).where(F.col("sim.s") > 0.6)
    pairs, edges = B.pairs(met, True), B.spanning(met, True)
    assert rows(connected_components(edges, "a_id", "b_id")) == rows(connected_components(pairs, "a_id", "b_id"))
    assert edges.count() < pairs.count() / 5 and edges.exceptAll(pairs.distinct()).subtract(pairs).isEmpty()


def test_documents_that_cannot_be_near_copies_are_not_compared(spark):
    """of the pairs that share a key, all near copies stay and most others go before a text is joined to them."""
    import random

    from linkweave.operators import windows as W

    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(20)]
    mixed = [base[i][:30] + base[(i + 1) % 20][30:] for i in range(20)]  # half of one, half of another
    copies = [base[i][: -1 - i % 4] + ["end"] for i in range(20)]
    texts = [" ".join(x) for x in base + mixed + copies]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = spark.sparkContext.broadcast(W.window_counts(df))
    keys = W.shared_keys(df, counts, 0.75, "doc_id")
    near = set(rows(W.near_candidates(keys, 0.75, "doc_id", 3)))
    every = set(rows(B.candidates(keys, [B.Blocking("w", lambda d: F.col("keys"), strict=False)], "doc_id")))
    sets = [set(W.window_set(x).tolist()) for x in texts]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.75}
    assert want and want <= near <= every and len(near) < len(every) / 2
