import itertools
import json
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from linkweave.functions import fields as P
from linkweave.operators import blocking as B
from linkweave.operators import classify as K
from linkweave.operators import compare as C
from linkweave.operators import grouping as G
from linkweave.plans import catalogue, reports
from linkweave.plans.linkage import LOG, Linkage, log_to
from linkweave.sources.csv_files import project, read_csv, union_projected, write_csv
from linkweave.streaming.incremental import link_stream


def near(a, b):
    return F.pow(F.lit(2.0), -F.abs(a - b))


def as_double(c):
    return c.cast("double")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def num(spark):
    return spark.createDataFrame([("A", 5.5), ("B", 4.5), ("C", 5.0)], "name string, num double")


def by_int(d):
    return F.col("num").cast("double").cast("int")


def test_scaled(ev):
    s = lambda *a, x=1, **k: ev(C.scaled(near, *a, **k)(F.lit(x), F.lit(2)))
    assert [s(), s(0.6), s(0.0, 0.4), s(0.4, 0.6), s(0.4, 0.6, 0.5)] == [0.5, 0.0, 1.0, 0.5, 0.25]
    assert s(test=lambda c: c > 1) is None
    with pytest.raises(ValueError, match="low"):
        C.scaled(near, 1.0, 0.5)


def pair(spark, comparator, a, b):
    both = spark.createDataFrame([(1, *a), (2, *b)], ["id", *(f"f{i}" for i in range(len(a)))])
    ids = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    return list(C.Record(*comparator).compare(ids, both.where("id = 1"), both.where("id = 2"), "id").first()["sim"])


def test_fields_of_records(spark):
    assert pair(spark, [("s", C.Field(near, "f1", as_double))], ("A", "1"), ("B", "2")) == [0.5]
    assert pair(spark, [("s", C.Field(near, "f0", as_double, "f1", as_double))], ("1", "x"), ("y", "2")) == [0.5]
    assert pair(spark, [("V1", C.Field(near, "f1")), ("V2", C.Field(near, "f2"))], ("A", 1, 1), ("B", 2, 4)) == [0.5, 0.125]
    assert pair(spark, [("s", C.Field(near, "f0"))], (1,), (None,)) == [None]
    split = lambda d: P.multivalue(";", F.col("f0"))
    for f, a, b, s in [
        (C.Average, "0;1", "1;2", 0.75),
        (C.Average, "0;1;2", "0;1;2;3;4", 1.0),
        (C.Average, "1;1", "-2;2", 0.5),
        (C.Maximum, "0;1", "2;2", 0.5),
        (C.Maximum, "0;1;2", "3;4;5", 0.5),
        (C.Average, "", "1", None),
        (C.Maximum, "", "", None),
    ]:
        assert pair(spark, [("s", f(near, split, as_double))], (a,), (b,)) == [s]


def test_candidates_and_counts(spark, num):
    block = [B.Blocking("int", by_int)]
    assert rows(B.candidates(num, block, "name")) == [("A", "C")]
    sims = C.Record(("s", C.Field(near, "num"))).compare(B.candidates(num, block, "name"), num, id_col="name")
    assert rows(sims.select("a_id", "b_id", F.round("sim.s", 9))) == [("A", "C", 0.707106781)]
    other = spark.createDataFrame([("D", 5.5), ("E", 4.5)], "name string, num double")
    assert rows(B.candidates(num, block, "name", other)) == [("A", "D"), ("B", "E"), ("C", "D")]
    ix, iy = B.index(num, block, "name"), B.index(other, block, "name")
    assert rows(B.count_self(ix)) == [("int", 1)] and rows(B.count_between(ix, iy)) == [("int", 3)]
    assert rows(B.block_stats(ix)) == [("int", 3, 2, 2, 1.5)]
    assert rows(B.search(other, num, block[0], "name")) == [("D", "A"), ("D", "C"), ("E", "B")]
    for split in (None, 1, 2):
        assert rows(B.all_pairs_within(num, "name", split)) == [("A", "B"), ("A", "C"), ("B", "C")]
        assert len(rows(B.all_pairs_between(num, other, "name", split))) == 6
    assert rows(B.all_pairs_count(num)) == [(3, 6)]


def test_keys_are_checked(num):
    empty = B.Blocking("x", lambda d: F.lit(""))
    with pytest.raises(Exception, match="empty key"):
        B.index(num, [empty], "name").collect()
    assert B.index(num, [B.Blocking("x", lambda d: F.lit(""), strict=False)], "name").count() == 0
    for bad in ((1, by_int), ("x", 3), ("x", by_int, "tree")):
        with pytest.raises(TypeError):
            B.Blocking(*bad)


def compared(spark, values):
    n = len(next(iter(values.values())))
    data = [(a, b, tuple(v)) for (a, b), v in values.items()]
    return spark.createDataFrame(data, "a_id long, b_id long, sim struct<" + ",".join(f"v{i}:double" for i in range(n)) + ">")


ONE = {(1, 2): [0.5], (2, 3): [0.8], (3, 4): [0.9], (4, 5): [0.0]}
TWO = {(1, 2): [0.5, None], (2, 3): [0.8, 0.7], (3, 4): [0.9, 0.5], (4, 5): [0.0, 0.5]}


def matched(df):
    return {tuple(r) for r in df.where("is_match").select("a_id", "b_id").collect()}


def test_classifiers(spark):
    for data in (ONE, TWO):
        out = K.kmeans_classify(compared(spark, data))
        assert matched(out) == {(1, 2), (2, 3), (3, 4)} and out.where("not is_match").count() == 1
    rule = lambda s: F.when(s["v0"] == 0, True)
    assert matched(K.nearest_classify(compared(spark, ONE), [[1.0]], [[0.4]], rule=rule)) == {(2, 3), (3, 4), (4, 5)}
    assert matched(K.nearest_classify(compared(spark, TWO), [[1, 0.8], [1, None]], [[0.3, 0.3]])) == {(2, 3), (3, 4)}
    some = K.rule_classify(compared(spark, {(1, 2): [0.8], (2, 3): [0.2], (3, 4): [None]}), lambda s: s["v0"] > 0.5)
    assert rows(some.select("a_id", "b_id", "score")) == [(1, 2, 1.0), (2, 3, 0.0)]
    with pytest.raises(TypeError):
        K.rule_verdicts(compared(spark, ONE), lambda s: s["v0"])
    with pytest.raises(Exception, match="no examples"):
        K.nearest_classify(compared(spark, ONE), [], [[0.1]]).collect()
    with pytest.raises(ValueError, match="without values"):
        K.kmeans_classify(compared(spark, {(1, 2): [None]}))
    assert K.kmeans_classify(compared(spark, ONE).where("false")).count() == 0


def test_examples(spark):
    data = [("TRUE", 1, "Joe1", 8), ("TRUE", 1, "Joe2", 7), ("TRUE", 1, "Joe3", 3), ("TRUE", 2, "Abe1", 3), ("TRUE", 2, "Abe2", 5), ("FALSE", 3, "Zip1", 9), ("FALSE", 3, "Zip2", 1), ("FALSE", 4, "Nobody", 1), ("maybe", 1, "x", 1)]
    df = spark.createDataFrame(data, ["Match", "ID", "Name", "Age"])
    yes, no = K.load_examples(C.Record(("V", C.Field(near, "Age"))), df, "Match", "ID", "Name")
    assert sorted(v for (v,) in yes) == [0.03125, 0.0625, 0.25, 0.5] and no == [[0.00390625]]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_groups(spark):
    adjacency = dict(map(tuple, G.adjacency_list(edges(spark, [(1, 2), (2, 3), (4, 5), (1, 5)])).collect()))
    assert adjacency == {1: [2, 5], 2: [1, 3], 3: [2], 4: [5], 5: [1, 4]}
    assert rows(G.connected_components(edges(spark, [(1, 2), (2, 3), (4, 5), (5, 6)]))) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4)]
    cycle = [(i, (i + 1) % 40) for i in range(40)] + [(50, 50), (60, None)]
    assert rows(G.connected_components(edges(spark, cycle))) == [(i, 0) for i in range(40)] + [(50, 50)]
    records = spark.range(1, 8).withColumnRenamed("id", "r")
    matches = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a_id long, b_id long")
    grouped = G.singles_and_groups(matches, records, "r")
    assert sorted(map(tuple, G.group_ids(grouped).select("r", "group_id").collect())) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1), (6, None), (7, None)]
    assert G.connected_components(edges(spark, [])).count() == 0


def same_int(c):
    return C.Record(("same", C.Field(lambda a, b: (a == b).cast("double"), c, lambda x: x.cast("double").cast("int"))))


def test_linkage_of_one_table_and_of_two(spark, tmp_path):
    df = spark.createDataFrame([("A", "5.5"), ("B", "3.5"), ("C", "5.25")], ["name", "num"])
    yes = lambda x: K.rule_classify(x, lambda s: s["same"] > 0.5)
    alone = Linkage([B.Blocking("int", by_int)], same_int("num"), yes, df)
    assert rows(alone.matches.select("a_id.id.name", "b_id.id.name")) == [("A", "C")]
    assert rows(alone.group_report()) == [("", "B", "3.5"), ("0", "A", "5.5"), ("0", "C", "5.25")]
    alone.write_all(str(tmp_path))
    assert {p.name for p in tmp_path.iterdir()} == {"input-records.csv", "InputIdx-int.csv", "match-comparisons.csv", "match-pairs.csv", "nonmatch-comparisons.csv", "nonmatch-pairs.csv", "groups.csv"}
    back = read_csv(spark, f"{tmp_path}/groups.csv")
    assert back.columns == ["GroupID", "name", "num"] and back.count() == 3
    for identity, groups in (("value", 2), ("row", 2)):
        two = Linkage([B.Blocking("int", by_int)], same_int("num"), yes, df, df, identity=identity)
        assert two.matches.count() == 5
        assert two.groups.select("component").distinct().count() == groups
        assert two.single_records.count() == 0 and two.matched_records.count() == 3
        assert two.projection == ["name", "num"]
    two.write_all(f"{tmp_path}/two")
    assert "input-matchrows.csv" in {p.name for p in (tmp_path / "two").iterdir()}


def test_repeated_rows(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], ["value"])
    same = C.Record(("s", C.Field(lambda a, b: (a == b).cast("double"), "value")))
    yes = lambda x: K.rule_classify(x, lambda s: s["s"] == 1)
    x = Linkage([B.Blocking("all", kind="all_pairs")], same, yes, df)
    assert x.comparisons.count() == 6 and x.matches.count() == 1
    assert x.groups.count() == 4 and x.groups.where("component is not null").count() == 2


def test_reports(spark, num):
    comparator = C.Record(("s", C.Field(near, "num")))
    blocks = [B.Blocking("int", by_int)]
    x = comparator.compare(B.candidates(num, blocks, "name"), num, id_col="name").withColumn("score", F.lit(1.0))
    report = reports.comparison_report(x, num, blocks, comparator, "name").orderBy("ordinal")
    assert [tuple(r)[3:] for r in report.collect()] == [("", "5", "5.5"), ("", "5", "5.0"), ("1.0", "True", "0.7071067811865475")]
    assert [tuple(r) for r in reports.pair_report(x, num, "name", fields=["num", "z"]).orderBy("ordinal").collect()] == [("A", "C", 1, "5.5", ""), ("A", "C", 2, "5.0", "")]
    assert rows(reports.index_dump(num, blocks, "name"))[0] == ("int", "4", "B", 4.5)


def test_csv(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("A, B\r\na,bé\r\n\"c \"\"q\"\"\",\r\n".encode("cp1252"))
    df = read_csv(spark, str(tmp_path / "in.csv"))
    assert df.columns == ["A", "B"] and rows(df) == [("a", "bé"), ('c "q"', "")]
    out = spark.createDataFrame([("é€梦", None)], "x string, y string")
    write_csv(out, str(tmp_path / "out"), single=True)
    data = next((tmp_path / "out").glob("part-*")).read_bytes()
    assert data == "x,y\r\né€,\r\n".encode("cp1252")
    (tmp_path / "bad.csv").write_bytes(b"A,B\n\x81,x\n")
    with pytest.raises(Exception, match="cp1252"):
        read_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "ragged.csv").write_bytes(b"A,B\nx\n")
    with pytest.raises(Exception):  # noqa: B017
        read_csv(spark, str(tmp_path / "ragged.csv")).collect()
    (tmp_path / "noname.csv").write_bytes(b"A,\nx,y\n")
    with pytest.raises(ValueError, match="name"):
        read_csv(spark, str(tmp_path / "noname.csv"))
    assert rows(read_csv(spark, str(tmp_path / "ragged.csv"), fields=["only"]).limit(0)) == []


def test_projection(spark):
    a = spark.createDataFrame([(1, 2, 3, 4)], ["a", "b", "x", "y"])
    b = spark.createDataFrame([(1, 2, 3, 4, 5)], ["a", "y", "c", "x", "z"])
    assert rows(union_projected(a, b)) == [("1", "", "4", "2", "3", "5"), ("1", "2", "3", "4", "", "")]
    assert rows(project(a, ["y", "q"])) == [(4, "")]


def test_stream(spark, num, tmp_path):
    (tmp_path / "in").mkdir()
    num.limit(2).write.mode("overwrite").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(num.schema).json(str(tmp_path / "in"))
    comparator = C.Record(("s", C.Field(near, "num")))
    q = link_stream(stream, num, [B.Blocking("int", by_int)], comparator, lambda x: K.rule_classify(x, lambda s: s["s"] > 0.9), "name", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")).where("is_match").select("a_id", "b_id")) == [("A", "A"), ("B", "B")]


def test_entry_and_oracle_names(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
    json.dumps(e.oracle_sql())


def test_document_groups_by_brute_force(spark):
    r = random.Random(3)
    words = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    opening, texts = words(40), []
    for _ in range(12):
        body = words(r.randint(20, 300))
        texts += [opening + body, ["new", "start"] + opening + body, body[:-1] + ["end"], body]
        texts.append([w if r.random() > 0.06 else "x" + w for w in opening + body])
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    rows += [(900, rows[0][1].upper() + "!"), (901, rows[0][1]), (902, None), (903, "..."), (904, "one"), (905, "One "), (906, "two")]
    norm = lambda t: " ".join(re.findall("[A-Za-z0-9_]+", (t or "").lower())).split()
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} for i, t in rows if (w := norm(t))}
    least = {i: i for i, _ in rows}
    linked = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    in_group = {i for p in linked for i in p}
    want = sorted((i, least[i] if i in in_group else None) for i, _ in rows)
    got = catalogue.document_groups(spark.createDataFrame(rows, "doc_id long, text string"), split=3)
    assert sorted(tuple(x) for x in got.collect()) == want
    assert least[1] == least[0] and len(set(least.values())) > 20

def test_kmeans_query_goes_on_until_it_converges(spark, tmp_path):
    r = random.Random(4)
    kinds = [" ".join(r.choice("red blue green ivory pink lime navy plum tan sky".split()) for _ in range(3)) for _ in range(300)]
    part = spark.createDataFrame([(i, k, "b", "t", 1 + i % 3, float(r.randint(900, 2000))) for i, k in enumerate(kinds)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    sims = catalogue._part_sims(catalogue.Tables(spark, str(tmp_path)))
    v = [tuple(x.sim) for x in sims.select("sim").collect()]
    pick = lambda f: [f(x[i] for x in v if x[i] is not None) for i in range(2)]
    mean = lambda side: [statistics.fmean(x[i] for x, y in zip(v, labels, strict=True) if y == side and x[i] is not None) for i in range(2)]
    far = lambda x, c: math.sqrt(sum((p - q) ** 2 for p, q in zip(x, c, strict=True) if p is not None))
    high, low, old, passes, at = pick(max), pick(min), None, 0, []
    while passes < 10:
        labels = [far(x, high) < far(x, low) for x in v]
        high, low, passes = mean(True), mean(False), passes + 1
        at.append(labels)
        if labels == old:
            break
        old = labels
    got = catalogue.QUERIES["kmeans_classify"](spark, str(tmp_path))
    assert got.where("is_match").count() == sum(at[-1]) != sum(at[2])


def test_csv_dialects(spark, tmp_path):
    from linkweave.sources.csv_files import read_csv, write_csv

    rows = [("a;b", "it's", "x\ty"), ("", "'q'", "\u20ac")]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    for n, how in enumerate(({"sep": ";"}, {"sep": "\t", "quote": "'"}, {"sep": "|", "quote": "'", "escape": "\\"})):
        path = str(tmp_path / str(n))
        write_csv(df, path, line_end="\n", **how)
        assert sorted(map(tuple, read_csv(spark, path, **how).collect())) == sorted(rows)
    (tmp_path / "t.csv").write_bytes(b"p;q\n1;'2;3'\n")
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv"), sep=";", quote="'").collect()] == [("1", "2;3")]


def test_examples_are_reported(spark, tmp_path):
    from linkweave.operators import classify, compare
    from linkweave.sources.csv_files import read_csv

    df = spark.createDataFrame([(1, "g", 1, 5.0), (2, "g", 1, 6.0), (3, "h", 0, 1.0), (4, "h", 0, 9.0)], "id long, k string, y int, v double")
    record = compare.Record(("v", compare.Field(lambda a, b: 1 / (1 + F.abs(a - b)), "v")))
    matches, others = classify.load_examples(record, df, "y", "k", "id", outdir=str(tmp_path))
    assert (matches, others) == ([[0.5]], [[1 / 9]])
    got = [tuple(r) for r in read_csv(spark, str(tmp_path / "examples_true.csv")).collect()]
    assert got == [("", "g", "5.0"), ("", "g", "6.0"), ("0", "True", "0.5")]
    assert len(read_csv(spark, str(tmp_path / "examples_false.csv")).collect()) == 3


def test_groups_are_numbered_over_ranges(spark):
    from linkweave.operators.grouping import group_ids

    df = spark.createDataFrame([(i, i // 3 * 10 if i % 5 else None) for i in range(200)], "id long, component long")
    got = {r.component: r.group_id for r in group_ids(df).collect()}
    order = sorted(c for c in got if c is not None)
    assert [got[c] for c in order] == list(range(len(order))) and got[None] is None


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from linkweave.plans.lineage import work_dir

    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local-cluster[3,2,1024]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(spark)


def test_rules_see_both_records(spark):
    people = spark.createDataFrame([(1, "Ann Pell", 1970, "x"), (2, "Ann Pel", 1970, None), (3, "Ann Pell", 1950, "x")], ["id", "name", "born", "is_match"])
    pairs = compared(spark, {(1, 2): [0.9], (1, 3): [1.0], (2, 3): [0.1]})
    rule = lambda s, a, b: F.when(s["v0"] > 0.5, a["born"] == b["born"])
    out = K.rule_classify(pairs, rule, (people, None, "id"))
    assert out.columns == ["a_id", "b_id", "sim", "is_match", "score"]
    assert rows(out.select("a_id", "b_id", "score")) == [(1, 2, 1.0), (1, 3, 0.0)]
    later = people.withColumn("born", F.col("born") + 20)
    assert matched(K.rule_classify(pairs, rule, (later, people, "id"))) == set()
    near = K.nearest_classify(pairs, [[0.2]], [[0.9]], rule=rule, sides=(people, None, "id"))
    assert matched(near) == {(1, 2), (2, 3)}
    same = C.Record(("s", C.Field(lambda a, b: (a == b).cast("double"), "name")))
    link = Linkage([B.Blocking("all", kind="all_pairs")], same, lambda x: K.rule_classify(x, lambda s, a, b: (s["s"] == 1) & (a["born"] > b["born"]), link.sides), people.drop("is_match"), people, "id")
    assert rows(link.matches.select("a_id.id", "b_id.id")) == [(1, 3)]


def test_the_log_tells_sizes_and_results(spark, tmp_path):
    df = spark.createDataFrame([("A", "5.5"), ("B", "3.5"), ("C", "5.25")], ["name", "num"])
    handler = log_to(str(tmp_path / "log"))
    try:
        Linkage([B.Blocking("int", by_int)], same_int("num"), lambda x: K.rule_classify(x, lambda s: s["same"] > 0.5), df, df).write_all(str(tmp_path / "out"))
    finally:
        LOG.removeHandler(handler)
        handler.close()
    lines = [x.split(" product=linkweave ")[1] for x in (tmp_path / "log").read_text().splitlines()]
    assert lines == ["index=int records=3 blocks=2 largest=2 average=1.5 comparisons=5", "master index=int records=3 blocks=2 largest=2 average=1.5", "name=Results compares=5 matches=5 nonmatch=0"]
