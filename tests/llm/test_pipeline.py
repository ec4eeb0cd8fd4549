import corpus_pipeline
import duckdb
import pytest

from linkweave.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = f"{corpus_pipeline.staged(out, 'test-stage').inputFiles()[0].rpartition('/')[0]}"
        docs = spark.read.parquet(path)
        assert docs.count() <= 3 * n, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        ids = [x.doc_id for x in docs.select("doc_id").collect()]
        if name == "n-gram Jaccard join":
            assert len(ids) == len(set(ids))
    assert docs.where("not round_trip").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = sorted(x[0] for x in want.description)
    order = [[x[0] for x in want.description].index(n) for n in names]
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    want = sorted((tuple(clean(r[i]) for i in order) for r in want.fetchall()), key=repr)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert sorted((tuple(clean(r[n]) for n in names) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
