"""Queries over the driver's tables, one for each operator, with the SQL they equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.functions import encode as E
from linkweave.functions import fields as P
from linkweave.functions import geo, phonetic, strings, vectors
from linkweave.operators import blocking as B
from linkweave.operators import classify as K
from linkweave.operators import compare as C
from linkweave.operators import grouping as G
from linkweave.operators import windows as W
from linkweave.plans import reports
from linkweave.plans.lineage import new_path, staged
from linkweave.plans.linkage import Linkage
from linkweave.sources.csv_files import project, read_csv, union_fields, union_projected

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


# Text normalisers

_ALNUM = lambda c: f"CASE WHEN {c} <> '' THEN trim(regexp_replace(lower({c}), '[^A-Za-z0-9_]+', ' ', 'g')) END"
_NORM = lambda c: f"CASE WHEN {c} <> '' THEN regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') END"


def _encoder(name: str, table: str, key: str, column: str, f: Callable[[Column], Column], sql: str) -> None:
    query(name, f"SELECT {key}, {sql} AS result FROM {table}")(lambda t: getattr(t, table).select(key, f(F.col(column)).alias("result")))


_encoder("enc_normspace", "documents", "doc_id", "text", E.normspace, _NORM("text"))
_encoder("enc_alnumsp", "part", "p_partkey", "p_type", E.alnumsp, _ALNUM("p_type"))
_encoder("enc_alnumcase", "part", "p_partkey", "p_brand", E.alnumcase, "CASE WHEN p_brand <> '' THEN trim(regexp_replace(p_brand, '[^A-Za-z0-9_]+', ' ', 'g')) END")
_encoder("enc_nospace", "documents", "doc_id", "text", E.nospace, "CASE WHEN text <> '' THEN regexp_replace(text, '\\s+', '', 'g') END")
_encoder("enc_lowstrip", "documents", "doc_id", "text", E.lowstrip, _NORM("lower(text)"))
_encoder("enc_digits", "customer", "c_custkey", "c_name", E.digits, "CASE WHEN c_name <> '' THEN regexp_replace(c_name, '[^0-9]+', '', 'g') END")
_encoder("enc_sorted_words", "part", "p_partkey", "p_name", E.sorted_words, "CASE WHEN p_name <> '' THEN array_to_string(list_sort(string_split(p_name, ' ')), ' ') END")
_encoder("enc_reverse", "customer", "c_custkey", "c_name", E.reverse, "CASE WHEN c_name <> '' THEN reverse(c_name) END")
_URL = "^(?:http://)?(?:www\\.)?([^/]+)(?:/.*)?"
_encoder("enc_urldomain", "pages", "page_id", "url", E.urldomain, f"CASE WHEN url <> '' THEN CASE WHEN regexp_matches(url, '{_URL}') THEN regexp_extract(url, '{_URL}', 1) ELSE url END END")
_MAIL = r"[A-Za-z0-9._]+@[A-Za-z0-9.-]+"
query("enc_emaildomain", f"SELECT doc_id, list_transform(regexp_extract_all(text, '{_MAIL}'), lambda m: CASE WHEN regexp_matches(m, '^([^@]+)@(.+)') THEN regexp_extract(m, '^([^@]+)@(.+)', 2) ELSE m END) AS result FROM documents")(
    lambda t: t.documents.select("doc_id", F.transform(F.regexp_extract_all("text", F.lit(_MAIL), F.lit(0)), E.emaildomain).alias("result"))
)
_encoder("enc_normaliser", "part", "p_partkey", "p_name", E.Normaliser({"crimson": ["red", "rouge"], "": ["small", "tiny"], "fastener": ["bolt", "nut$"]}),
         r"trim(regexp_replace(regexp_replace(regexp_replace(p_name, '(?i)\b(red|rouge)\b', 'crimson', 'g'), '(?i)\b(small|tiny)\b', '', 'g'), '(?i)\b(bolt|nut$)\b', 'fastener', 'g'))")
_encoder("enc_wrap", "part", "p_partkey", "p_name", P.wrap(E.sorted_words, E.reverse), "array_to_string(list_sort(string_split(reverse(p_name), ' ')), ' ')")
_encoder("enc_scale", "part", "p_partkey", "p_retailprice", lambda c: E.scale(c, 950, 1050), "CASE WHEN p_retailprice <= 950 THEN 0.0 WHEN p_retailprice >= 1050 THEN 1.0 ELSE (p_retailprice - 950) / 100.0 END")


@query("enc_dmetaphone")
def _(t):
    codes = phonetic.double_metaphone(F.col("p_name"))
    return t.part.select("p_partkey", codes[0].alias("code"), codes[1].alias("alternate"))


_SOUND = "regexp_replace(translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230127022455012623017202'), '[^0-9]', '0', 'g')"
_RUNS = "s[1] || replace(s[2:], '7', '')"
for _d in "0123456":
    _RUNS = f"regexp_replace({_RUNS}, '{_d}+', '{_d}', 'g')"


@query("enc_soundex", f"""
WITH c AS (SELECT p_partkey, p_name, {_SOUND} AS s FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '^[A-Za-z]') THEN rpad(left(upper(p_name[1]) || replace(({_RUNS})[2:], '0', ''), 4), 4, '0') ELSE p_name END AS result FROM c
""")
def _(t):
    return t.part.select("p_partkey", F.soundex("p_name").alias("result"))


# Fields

@query("get_getter", "SELECT p_partkey, p_name AS by_name, p_brand AS by_place, p_name || '/' || p_brand AS by_function FROM part")
def _(t):
    df = t.part
    return df.select("p_partkey", P.getter(df, "p_name").alias("by_name"), P.getter(df, 2).alias("by_place"), P.getter(df, lambda d: F.concat_ws("/", d.p_name, d.p_brand)).alias("by_function"))


@query("get_dictattr", "SELECT c_custkey, c_name AS has, NULL::VARCHAR AS has_not FROM customer")
def _(t):
    m = F.create_map(F.lit("name"), F.col("c_name"))
    return t.customer.select("c_custkey", P.dict_get(m, "name").alias("has"), P.dict_get(m, "phone").alias("has_not"))


@query("get_fallback", "SELECT p_partkey, CASE WHEN p_size % 3 <> 0 AND p_size % 2 <> 0 THEN p_name WHEN p_size % 5 <> 0 THEN p_brand ELSE 'none' END AS result FROM part")
def _(t):
    a = F.when(F.col("p_size") % 3 != 0, F.when(F.col("p_size") % 2 != 0, F.col("p_name")).otherwise(""))
    b = F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))
    return t.part.select("p_partkey", P.fallback(a, b, default="none").alias("result"))


@query("get_combine", "SELECT p_partkey, list_filter(list_transform([p_name, CASE WHEN p_size % 2 = 0 THEN '  ' ELSE ' ' || p_brand END, p_type], lambda x: trim(x)), lambda x: x <> '') AS result FROM part")
def _(t):
    blank = F.when(F.col("p_size") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("p_brand")))
    return t.part.select("p_partkey", P.combine(F.col("p_name"), blank, F.col("p_type")).alias("result"))


@query("get_multivalue", "SELECT p_partkey, list_filter(string_split(p_name, ' ') || string_split(p_brand, '#'), lambda x: trim(x) <> '') AS result FROM part")
def _(t):
    return t.part.select("p_partkey", P.multivalue("#", F.translate("p_name", " ", "#"), F.col("p_brand")).alias("result"))


@query("get_convert", "SELECT c_custkey, lower(c_mktsegment) AS result FROM customer")
def _(t):
    return t.customer.select("c_custkey", P.convert(F.col("c_mktsegment"), F.lower).alias("result"))


@query("list_convert", "SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x)) AS result FROM part")
def _(t):
    return t.part.select("p_partkey", P.list_convert(F.split("p_name", " "), F.upper).alias("result"))


_SIZES = "[CASE WHEN p_size % 2 = 0 THEN p_size END, CASE WHEN p_size % 3 = 0 THEN p_size + 1 END]"


def _sizes() -> Column:
    return F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_size")), F.when(F.col("p_size") % 3 == 0, F.col("p_size") + 1))


@query("list_delnone", f"SELECT p_partkey, list_filter({_SIZES}, lambda x: x IS NOT NULL) AS result FROM part")
def _(t):
    return t.part.select("p_partkey", P.delnone(_sizes()).alias("result"))


@query("list_nullmax", f"SELECT p_partkey, list_max({_SIZES}) AS result FROM part")
def _(t):
    return t.part.select("p_partkey", P.nullmax(_sizes()).alias("result"))


@query("proj_fields", "SELECT c_name, '' AS phone, c_custkey FROM customer")
def _(t):
    return project(t.customer, ["c_name", "phone", "c_custkey"])


@query("proj_unionfields", """
SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment, '' AS balance FROM customer
UNION ALL SELECT s_suppkey::VARCHAR, s_name, '', s_acctbal::VARCHAR FROM supplier
""")
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    assert union_fields(a.columns, b.columns) == ["key", "name", "segment", "balance"]
    return union_projected(a, b)


# Coordinates

_LAT, _LON = "(c_custkey * 37 % 2000) / 10.0 - 100.0", "(c_custkey * 91 % 4000) / 10.0 - 200.0"
_POINTS = f"p AS (SELECT c_custkey, ({_LAT})::DOUBLE AS lat, ({_LON})::DOUBLE AS lon FROM customer)"
_OK = "lat > -90 AND lat < 90 AND lon > -180 AND lon < 180"
_KM = """CASE WHEN cosine >= 1 THEN 0.0 WHEN 6372.0 * acos(greatest(cosine, -1.0)) <= 0.003 THEN 0.0 ELSE 6372.0 * acos(greatest(cosine, -1.0)) END"""
_COS = "sin(radians(lon)) * sin(radians(20)) + cos(radians(lon)) * cos(radians(20)) * cos(radians(10) - radians(lat))"


def _points(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", geo.point(F.expr(_LAT.replace("10.0", "10.0D").replace("100.0D", "100.0D")).cast("string"), F.expr(_LON.replace("10.0", "10.0D")).cast("string")).alias("p"))


def _home() -> Column:
    return F.struct(F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"))


@query("geo_getter", f"WITH {_POINTS} SELECT c_custkey, round(lat, 6) AS lat, round(lon, 6) AS lon FROM p")
def _(t):
    return _points(t).select("c_custkey", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


@query("geo_valid", f"WITH {_POINTS} SELECT c_custkey, {_OK} AS result FROM p")
def _(t):
    return _points(t).select("c_custkey", geo.valid(F.col("p")).alias("result"))


@query("geo_distance", f"WITH {_POINTS}, d AS (SELECT c_custkey, {_COS} AS cosine FROM p) SELECT c_custkey, round({_KM}, 6) AS result FROM d")
def _(t):
    return _points(t).select("c_custkey", F.round(geo.distance(F.col("p"), _home()), 6).alias("result"))


@query("geo_similarity", f"""
WITH {_POINTS}, d AS (SELECT *, {_COS} AS cosine FROM p), e AS (SELECT *, {_KM} AS km FROM d)
SELECT c_custkey, CASE WHEN {_OK} THEN round(CASE WHEN km <= 500 THEN 1.0 WHEN km >= 9000 THEN 0.0 ELSE 1.0 - (km - 500) / 8500.0 END, 6) END AS result FROM e
""")
def _(t):
    return _points(t).select("c_custkey", F.round(geo.similarity(F.col("p"), _home(), 500, 9000), 6).alias("result"))


# Pairs of parts, and comparators on them

_KEYS = ("p_brand", "p_type", "p_size")
_PAIRS = "pairs AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, a.p_name AS an, b.p_name AS bn, a.p_retailprice AS ap, b.p_retailprice AS bp FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)"
_LEV = "1 - levenshtein(an, bn) / greatest(length(an), length(bn))::DOUBLE"
_PRICE = "1 / (1 + abs(ap - bp) / 100)"
_SIM = f"sims AS (SELECT a_id, b_id, {_LEV} AS name, CASE WHEN a_id % 7 <> 0 AND b_id % 7 <> 0 THEN {_PRICE} END AS price FROM pairs)"
_PRICED = lambda d: F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice"))


def _near(a: Column, b: Column) -> Column:
    return 1 / (1 + F.abs(a - b) / 100)


def _equal(a: Column, b: Column) -> Column:
    return (a == b).cast("double")


def part_blocks() -> B.Blocking:
    return B.Blocking("kind", lambda d: F.concat_ws("|", *_KEYS))


def part_comparator() -> C.Record:
    return C.Record(("name", C.Field(strings.levenshtein_similarity, "p_name")), ("price", C.Field(_near, _PRICED)))


def _part_pairs(t: Tables) -> DataFrame:
    return B.candidates(t.part, [part_blocks()], "p_partkey")


def _part_bundles(t: Tables) -> DataFrame:
    return part_comparator().compare_bundles(t.part, [part_blocks()], "p_partkey")


def _part_sims(t: Tables) -> DataFrame:
    return part_comparator().compare_blocks(t.part, [part_blocks()], "p_partkey")


def _part_names(t: Tables, result: Callable[[Column, Column], Column]) -> DataFrame:
    """(a_id, b_id, result) of the names of each pair."""
    met = B.meet(t.part, [part_blocks()], "p_partkey", values=(F.col("p_name"), None))
    return B.pairs(met.select("a_ids", "b_ids", result(F.col("a_v"), F.col("b_v")).alias("result")), True, "result")


@query("lev_distance", f"WITH {_PAIRS} SELECT a_id, b_id, levenshtein(an, bn)::INTEGER AS result FROM pairs")
def _(t):
    return _part_names(t, strings.levenshtein_distance)


@query("lev_similarity", f"WITH {_PAIRS} SELECT a_id, b_id, {_LEV} AS result FROM pairs")
def _(t):
    return _part_names(t, strings.levenshtein_similarity)


@query("lev_sequence", """
WITH w AS (SELECT a.p_partkey AS a_id, b.p_partkey AS b_id, string_split(a.p_name, ' ') AS x, string_split(b.p_name, ' ') AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey)
SELECT a_id, b_id, ((x[1] <> y[1])::BIGINT + (x[2] <> y[2])::BIGINT) AS result FROM w
""")
def _(t):
    return _part_names(t, lambda a, b: strings.sequence_distance(F.split(a, " "), F.split(b, " ")))


#: Matrix rows before and at i, for all pairs at once, from the recurrence.
_OSA = f"""
WITH RECURSIVE {_PAIRS}, m AS (
  SELECT a_id, b_id, an, bn, 0 AS i, []::BIGINT[] AS p, range(length(bn) + 1) AS r FROM pairs
  UNION ALL
  SELECT a_id, b_id, an, bn, i + 1, r, list_reduce(list_transform(range(length(bn) + 1), lambda j: CASE WHEN j = 0 THEN [i + 1] ELSE [least(
    r[j + 1] + 1, r[j] + (an[i + 1] <> bn[j])::BIGINT,
    CASE WHEN i > 0 AND j > 1 AND an[i + 1] = bn[j - 1] AND an[i] = bn[j] THEN p[j - 1] + 1 ELSE 1000000 END)] END),
    lambda x, y: list_append(x, least(y[1], x[len(x)] + 1))) FROM m WHERE i < length(an)
), osa AS (SELECT a_id, b_id, an, bn, r[len(r)]::BIGINT AS d FROM m WHERE i = length(an))
"""


@query("osa_distance", f"{_OSA} SELECT a_id, b_id, d AS result FROM osa")
def _(t):
    return _part_names(t, strings.osa_distance)


@query("osa_similarity", f"{_OSA} SELECT a_id, b_id, 1 - d / greatest(length(an), length(bn))::DOUBLE AS result FROM osa")
def _(t):
    return _part_names(t, strings.osa_similarity)


@query("sim_scale", f"WITH {_PAIRS}, s AS (SELECT *, {_LEV} AS v FROM pairs) SELECT a_id, b_id, CASE WHEN v <= 0.2 THEN 0.0 WHEN v >= 0.8 THEN 1.0 ELSE 0.5 * (v - 0.2) / 0.6000000000000001 END AS result FROM s")
def _(t):
    f = C.scaled(strings.levenshtein_similarity, 0.2, 0.8, 0.5)
    return _part_names(t, f)


@query("sim_scale_test", f"WITH {_PAIRS} SELECT a_id, b_id, CASE WHEN length(an) > 9 AND length(bn) > 9 THEN {_LEV} ELSE -1.0 END AS result FROM pairs")
def _(t):
    f = C.scaled(strings.levenshtein_similarity, missing=-1.0, test=lambda c: F.length(c) > 9)
    return _part_names(t, f)


@query("field_sim", f"WITH {_PAIRS} SELECT a_id, b_id, CASE WHEN a_id % 7 <> 0 AND b_id % 7 <> 0 THEN {_PRICE} END AS result FROM pairs")
def _(t):
    return C.Record(("result", C.Field(_near, _PRICED))).compare_blocks(t.part, [part_blocks()], "p_partkey").select("a_id", "b_id", "sim.result")


@query("field_sim_cross", """
SELECT c_custkey AS a_id, s_suppkey AS b_id, 1 - levenshtein(regexp_replace(c_name, '[^0-9]+', '', 'g'), reverse(regexp_replace(s_name, '[^0-9]+', '', 'g'))) / 9.0::DOUBLE AS result
FROM customer JOIN supplier ON c_nationkey = s_nationkey
""")
def _(t):
    c, s = t.customer.withColumnRenamed("c_custkey", "id"), t.supplier.withColumnRenamed("s_suppkey", "id")
    blocks = [B.Blocking("nation", lambda d: F.col("c_nationkey"))], [B.Blocking("nation", lambda d: F.col("s_nationkey"))]
    f = C.Field(strings.levenshtein_similarity, "c_name", E.digits, "s_name", P.wrap(E.reverse, E.digits))
    return C.Record(("result", f)).compare_blocks(c, blocks[0], "id", s, blocks[1]).select("a_id", "b_id", "sim.result")


_WORDS2 = "w AS (SELECT a_id, b_id, list_distinct(string_split(an, ' ')) AS x, list_distinct(string_split(bn, ' ')) AS y FROM pairs)"
_WLEV = "1 - levenshtein(u, v) / greatest(length(u), length(v))::DOUBLE"


def _words(f: type[C.Field]) -> Callable[[Tables], DataFrame]:
    one = f(strings.levenshtein_similarity, lambda d: F.split("p_name", " "))
    met = lambda t: C.Record(("s", one)).compare_bundles(t.part, [part_blocks()], "p_partkey")
    return lambda t: B.pairs(met(t).withColumn("result", F.round("sim.s", 9)), True, "result")


query("avg_multivalue", f"""
WITH {_PAIRS}, {_WORDS2}, o AS (SELECT a_id, b_id, CASE WHEN len(x) <= len(y) THEN x ELSE y END AS s, CASE WHEN len(x) <= len(y) THEN y ELSE x END AS l FROM w),
u AS (SELECT a_id, b_id, l, unnest(s) AS u FROM o), v AS (SELECT a_id, b_id, u, unnest(l) AS v FROM u), m AS (SELECT a_id, b_id, u, max({_WLEV}) AS m FROM v GROUP BY ALL)
SELECT a_id, b_id, round(avg(m), 9) AS result FROM m GROUP BY ALL
""")(_words(C.Average))
query("max_multivalue", f"""
WITH {_PAIRS}, {_WORDS2}, u AS (SELECT a_id, b_id, y, unnest(x) AS u FROM w), v AS (SELECT a_id, b_id, u, unnest(y) AS v FROM u)
SELECT a_id, b_id, round(max({_WLEV}), 9) AS result FROM v GROUP BY ALL
""")(_words(C.Maximum))


@query("record_sim", f"WITH {_PAIRS}, {_SIM} SELECT * FROM sims")
def _(t):
    return _part_sims(t).select("a_id", "b_id", "sim.*")


# Candidates and counts

@query("allpairs_within", "SELECT a.s_suppkey AS a_id, b.s_suppkey AS b_id FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey")
def _(t):
    return B.all_pairs_within(t.supplier, "s_suppkey", split=256)


@query("allpairs_between", "SELECT n_nationkey AS a_id, r_regionkey AS b_id FROM nation, region")
def _(t):
    return B.all_pairs_between(t.nation.withColumnRenamed("n_nationkey", "id"), t.region.withColumnRenamed("r_regionkey", "id"), "id")


@query("block_self", f"WITH {_PAIRS} SELECT a_id, b_id FROM pairs")
def _(t):
    return _part_pairs(t)


def customer_blocks() -> list[B.Blocking]:
    return [B.Blocking("segment", lambda d: F.concat_ws("|", "c_nationkey", "c_mktsegment")), B.Blocking("tail", lambda d: F.substring("c_name", -3, 3))]


_CUSTOMERS = """FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment
UNION SELECT a.c_custkey, b.c_custkey FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey AND right(a.c_name, 3) = right(b.c_name, 3)"""


@query("block_multi_index", f"SELECT a.c_custkey AS a_id, b.c_custkey AS b_id {_CUSTOMERS}")
def _(t):
    return B.candidates(t.customer, customer_blocks(), "c_custkey")


@query("block_split", f"SELECT a.c_custkey AS a_id, b.c_custkey AS b_id {_CUSTOMERS}")
def _(t):
    return B.candidates(t.customer, customer_blocks(), "c_custkey", split=8)


@query("block_between", "SELECT c_custkey AS a_id, s_suppkey AS b_id FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def _(t):
    c, s = t.customer.withColumnRenamed("c_custkey", "id"), t.supplier.withColumnRenamed("s_suppkey", "id")
    return B.candidates(c, [B.Blocking("nation", lambda d: F.col("c_nationkey"))], "id", s, [B.Blocking("nation", lambda d: F.col("s_nationkey"))])


def _nation(d: DataFrame) -> Column:
    return F.col("nation")


@query("block_search", "SELECT s_suppkey AS probe_id, c_custkey AS id FROM supplier JOIN customer ON c_nationkey = s_nationkey")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"))
    return B.search(s, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), B.Blocking("nation", _nation), "id")


def _part_index(t: Tables) -> DataFrame:
    return B.index(t.part, [part_blocks(), B.Blocking("words", lambda d: F.split("p_name", " "))], "p_partkey")


_IX = "ix AS (SELECT 'kind' AS index_name, concat_ws('|', p_brand, p_type, p_size) AS key, p_partkey AS id FROM part UNION ALL SELECT 'words', unnest(string_split(p_name, ' ')), p_partkey FROM part)"
_IXN = f"WITH {_IX}, n AS (SELECT index_name, key, count(*) AS n FROM ix GROUP BY ALL)"


@query("block_index", f"WITH {_IX} SELECT * FROM ix")
def _(t):
    return _part_index(t)


@query("block_lists", "SELECT p_size::VARCHAR AS key, list_sort(list(p_partkey)) AS ids FROM part GROUP BY p_size")
def _(t):
    return B.block_lists(t.part, B.Blocking("size", lambda d: F.col("p_size")), "p_partkey")


@query("block_index_dump", "SELECT 'size' AS index_name, p_size::VARCHAR AS key, part.* FROM part")
def _(t):
    return reports.index_dump(t.part, [B.Blocking("size", lambda d: F.col("p_size"))], "p_partkey")


@query("block_count", f"{_IXN} SELECT index_name, sum(n * (n - 1) // 2)::BIGINT AS comparisons FROM n GROUP BY 1")
def _(t):
    return B.count_self(_part_index(t))


@query("block_count_between", "SELECT 'nation' AS index_name, count(*)::BIGINT AS comparisons FROM customer JOIN supplier ON c_nationkey = s_nationkey")
def _(t):
    ix = lambda df, k, n: B.index(df.withColumnRenamed(n, "nation"), [B.Blocking("nation", _nation)], k)
    return B.count_between(ix(t.customer, "c_custkey", "c_nationkey"), ix(t.supplier, "s_suppkey", "s_nationkey"))


@query("allpairs_count", "SELECT 'within' AS kind, n * (n - 1) // 2 AS comparisons, n * (n + 1) // 2 AS upper_bound FROM (SELECT count(*) AS n FROM part) UNION ALL SELECT 'between', n * m, n * m FROM (SELECT count(*) AS n FROM part), (SELECT count(*) AS m FROM supplier)")
def _(t):
    return B.all_pairs_count(t.part).select(F.lit("within").alias("kind"), "*").unionAll(B.all_pairs_count(t.part, t.supplier).select(F.lit("between"), "*"))


@query("block_stats", f"{_IXN} SELECT index_name, sum(n)::BIGINT AS records, count(*) AS blocks, max(n) AS largest, round(avg(n), 2) AS average FROM n GROUP BY 1")
def _(t):
    return B.block_stats(_part_index(t))


@query("explain_blocking", f"{_IXN} SELECT index_name, sum(n)::BIGINT AS records, count(*) AS blocks, max(n) AS largest, round(avg(n), 2) AS average, sum(n * (n - 1) // 2)::BIGINT AS comparisons FROM n GROUP BY 1")
def _(t):
    return B.explain_blocking(_part_index(t))


# Vectors

#: All components, each null in every seventh vector, against a centre with its own nulls.
_V = "list_transform(range(len(embedding)), lambda i: CASE WHEN (vec_id + i) % 7 <> 3 THEN embedding[i + 1]::DOUBLE END)"
_C, _S = "CASE WHEN i % 11 <> 5 THEN (i % 9) / 10.0::DOUBLE - 0.4::DOUBLE END", "(1 + i % 4) / 4.0::DOUBLE"
_DIFF = lambda by: f"SELECT vec_id, round(sqrt(coalesce(list_sum(list_transform(range(len(e)), lambda i: ((e[i + 1] - ({_C})) / {by}) ** 2)), 0)), 9) AS result FROM (SELECT vec_id, {_V} AS e FROM embeddings)"


def _vectors() -> list[Column]:
    """A vector with nulls, the centre, the deviations."""
    at = lambda f: F.transform("embedding", lambda x, i: f(x, i))
    v = at(lambda x, i: F.when((F.col("vec_id") + i) % 7 != 3, x.cast("double")))
    c = at(lambda x, i: F.when(i % 11 != 5, (i % 9).cast("double") / F.lit(10.0) - F.lit(0.4)))
    return [v, c, at(lambda x, i: (1 + i % 4).cast("double") / F.lit(4.0))]


@query("l2_distance", _DIFF("1"))
def _(t):
    v, c, _ = _vectors()
    return t.embeddings.select("vec_id", F.round(vectors.l2(v, c), 9).alias("result"))


@query("norml2_distance", _DIFF(f"({_S})"))
def _(t):
    return t.embeddings.select("vec_id", F.round(vectors.norm_l2(*_vectors()), 9).alias("result"))


# Classification

_RULE = "CASE WHEN name > 0.6 THEN true WHEN name < 0.3 THEN false WHEN price > 0.9 THEN true END"


def _rule(sim: Column) -> Column:
    return F.when(sim["name"] > 0.6, True).when(sim["name"] < 0.3, False).when(sim["price"] > 0.9, True)


@query("rule_tristate", f"WITH {_PAIRS}, {_SIM} SELECT a_id, b_id, {_RULE} AS is_match FROM sims")
def _(t):
    return B.pairs(K.rule_verdicts(_part_bundles(t), _rule), True, "is_match")


@query("rule_classify", f"WITH {_PAIRS}, {_SIM}, r AS (SELECT a_id, b_id, {_RULE} AS is_match FROM sims) SELECT *, is_match::INTEGER::DOUBLE AS score FROM r WHERE is_match IS NOT NULL")
def _(t):
    return B.pairs(K.rule_classify(_part_bundles(t), _rule), True, "is_match", "score")


@query("rule_records", f"""
WITH {_PAIRS}, {_SIM}, r AS (SELECT a_id, b_id, CASE WHEN name > 0.6 THEN x.p_size = y.p_size WHEN abs(x.p_size - y.p_size) > 20 THEN false END AS is_match
FROM sims JOIN part x ON x.p_partkey = a_id JOIN part y ON y.p_partkey = b_id)
SELECT *, is_match::INTEGER::DOUBLE AS score FROM r WHERE is_match IS NOT NULL
""")
def _(t):
    rule = lambda sim, a, b: F.when(sim["name"] > 0.6, a["p_size"] == b["p_size"]).when(F.abs(a["p_size"] - b["p_size"]) > 20, False)
    met = part_comparator().compare_bundles(t.part, [part_blocks()], "p_partkey", carry=lambda d: F.struct("p_size"))
    return B.pairs(K.rule_classify(met, rule, K.CARRIED), True, "is_match", "score")


_MATCHES, _NONMATCHES = ([0.9, 0.9], [0.8, None]), ([0.2, 0.1], [0.4, 0.5])
_L2 = lambda a, b: f"sqrt({' + '.join(f'coalesce(({x} - {y}) * ({x} - {y}), 0)' for x, y in zip(('name', 'price'), (a, b), strict=True) if y is not None)})"
_DIST = f"dist AS (SELECT *, least({', '.join(_L2(*v) for v in _MATCHES)}) AS m, least({', '.join(_L2(*v) for v in _NONMATCHES)}) AS n FROM sims)"


@query("nearest_classify", f"WITH {_PAIRS}, {_SIM}, {_DIST} SELECT a_id, b_id, m < n AS is_match, round(log10((n + 0.1) / (m + 0.1)), 9) AS score FROM dist")
def _(t):
    x = K.nearest_classify(_part_bundles(t), _MATCHES, _NONMATCHES)
    return B.pairs(x.withColumn("score", F.round("score", 9)), True, "is_match", "score")


@query("nearest_with_rule", f"WITH {_PAIRS}, {_SIM}, {_DIST}, r AS (SELECT *, {_RULE} AS r FROM dist) SELECT a_id, b_id, coalesce(r, m < n) AS is_match, round(coalesce(r::INTEGER::DOUBLE, log10((n + 0.1) / (m + 0.1))), 9) AS score FROM r")
def _(t):
    x = K.nearest_classify(_part_bundles(t), _MATCHES, _NONMATCHES, rule=_rule)
    return B.pairs(x.withColumn("score", F.round("score", 9)), True, "is_match", "score")


_KD = lambda c, side: f"sqrt(coalesce((name - {c}.{side}n) * (name - {c}.{side}n), 0) + coalesce((price - {c}.{side}p) * (price - {c}.{side}p), 0))"
_KPASS = lambda i: f"""k{i + 1} AS MATERIALIZED (SELECT s.*, {_KD(f'c{i}', 'h')} < {_KD(f'c{i}', 'l')} AS y FROM sims s, c{i}),
c{i + 1} AS MATERIALIZED (SELECT avg(name) FILTER (y) AS hn, avg(price) FILTER (y) AS hp, avg(name) FILTER (NOT y) AS ln, avg(price) FILTER (NOT y) AS lp FROM k{i + 1})"""  # noqa: E731


@query("kmeans_classify", f"""
WITH {_PAIRS}, {_SIM}, c0 AS (SELECT max(name) AS hn, max(price) AS hp, min(name) AS ln, min(price) AS lp FROM sims),
{", ".join(map(_KPASS, range(10)))}
SELECT a_id, b_id, y AS is_match, round(log10(({_KD('c10', 'l')} + 0.1) / ({_KD('c10', 'h')} + 0.1)), 6) AS score FROM k10, c10
""")
def _(t):
    x = K.kmeans_classify(_part_bundles(t).withColumn("n", B.count_pairs(F.col("a_ids"), F.col("b_ids"))), weight="n")
    return B.pairs(x.withColumn("score", F.round("score", 6)), True, "is_match", "score")


@query("examples_vectors", """
WITH x AS (SELECT l.doc_id, l.quality = 1 AS label, d.lang || '|' || d.source AS key, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality IN (0, 1))
SELECT a.label, a.doc_id AS a_id, b.doc_id AS b_id, 1 / (1 + abs(a.n_chars - b.n_chars) / 100) AS size FROM x a JOIN x b ON a.label = b.label AND a.key = b.key AND a.doc_id < b.doc_id
""")
def _(t):
    x = t.labels.join(t.documents.drop("text"), "doc_id").withColumn("key", F.concat_ws("|", "lang", "source"))
    return K.example_vectors(C.Record(("size", C.Field(_near, "n_chars"))), x, "quality", "key", "doc_id").select("label", "a_id", "b_id", "sim.size")


# Groups and reports

_MATCHED = f"matched AS (SELECT a_id, b_id, name, price FROM sims WHERE name > 0.6)"
_EDGES = "es AS (SELECT a_id AS u, b_id AS v FROM matched UNION ALL SELECT b_id, a_id FROM matched)"
_COMPONENTS = "cc AS (SELECT u AS node, u AS r FROM es UNION SELECT es.v, cc.r FROM cc JOIN es ON es.u = cc.node), comp AS (SELECT node, min(r) AS component FROM cc GROUP BY node)"
_GROUPS = f"WITH RECURSIVE {_PAIRS}, {_SIM}, {_MATCHED}, {_EDGES}, {_COMPONENTS}"


def _part_matches(t: Tables) -> DataFrame:
    """Bundles that match."""
    return _part_bundles(t).where(F.col("sim.name") > 0.6)


@query("adjacency", f"{_GROUPS} SELECT u AS node, list_sort(list(v)) AS neighbours FROM es GROUP BY u")
def _(t):
    return G.bundle_adjacency(_part_matches(t))


@query("components", f"{_GROUPS} SELECT node, component FROM comp")
def _(t):
    return G.connected_components(B.spanning(_part_matches(t), True), "a_id", "b_id")


@query("singles_groups", f"{_GROUPS} SELECT p_partkey, component FROM part LEFT JOIN comp ON node = p_partkey")
def _(t):
    return G.singles_and_groups(B.spanning(_part_matches(t), True), t.part, "p_partkey").select("p_partkey", "component")


@query("group_report", f"{_GROUPS}, g AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS g FROM (SELECT DISTINCT component FROM comp)) SELECT coalesce(g.g::VARCHAR, '') AS GroupID, p_partkey, p_name FROM part LEFT JOIN comp ON node = p_partkey LEFT JOIN g ON g.component = comp.component")
def _(t):
    return reports.group_report(G.singles_and_groups(B.spanning(_part_matches(t), True), t.part, "p_partkey"), ["p_partkey", "p_name"])


_TEXT_PRICE = "CASE WHEN {0} % 7 <> 0 THEN round({1} * 10)::BIGINT::VARCHAR ELSE '' END"


@query("comparison_report", f"""
WITH {_PAIRS}, k AS (SELECT pairs.*, a.p_brand || '|' || a.p_type || '|' || a.p_size AS key, a.p_size AS asz, b.p_size AS bsz FROM pairs JOIN part a ON a.p_partkey = a_id JOIN part b ON b.p_partkey = b_id WHERE an = bn)
SELECT a_id, b_id, 1 AS ordinal, '' AS "Score", key AS kind, string_split(an, ' ')[1] AS first, an AS same, asz::VARCHAR AS size FROM k
UNION ALL SELECT a_id, b_id, 2, '', key, string_split(bn, ' ')[1], bn, bsz::VARCHAR FROM k
UNION ALL SELECT a_id, b_id, 3, '1.0', 'True', CASE WHEN string_split(an, ' ')[1] = string_split(bn, ' ')[1] THEN 'True' ELSE 'False' END, '1.0', '1.0' FROM k
""")
def _(t):
    blocks = [part_blocks(), B.Blocking("first", lambda d: F.split("p_name", " ")[0])]
    comparator = C.Record(("same", C.Field(_equal, "p_name")), ("size", C.Field(_equal, "p_size")))
    x = comparator.compare_bundles(t.part, [part_blocks()], "p_partkey", carry=lambda d: reports.cells(d, 0, blocks, comparator))
    x = K.rule_classify(x, lambda s: s["same"] == 1).where("is_match")
    return B.pairs(x.select("a_ids", "b_ids", reports.comparison_rows(x, blocks, comparator).alias("rows")), True, "rows").select("a_id", "b_id", F.explode("rows").alias("r")).select("a_id", "b_id", "r.*")


@query("pair_report", f"""
WITH {_PAIRS}, {_SIM}, {_MATCHED}
SELECT a_id, b_id, 1 AS ordinal, p_partkey::VARCHAR AS p_partkey, p_name, '' AS note FROM matched JOIN part ON p_partkey = a_id
UNION ALL SELECT a_id, b_id, 2, p_partkey::VARCHAR, p_name, '' FROM matched JOIN part ON p_partkey = b_id
""")
def _(t):
    fields = ["p_partkey", "p_name", "note"]
    met = part_comparator().compare_bundles(t.part, [part_blocks()], "p_partkey", member=lambda d: reports.record_cells(d, fields))
    x = B.pairs(met.where(F.col("sim.name") > 0.6), True)
    return reports.pair_rows(x.select("a_id.id", "b_id.id", "a_id.m", "b_id.m").toDF("a_id", "b_id", "ra", "rb"))


_LINKED = "l AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND abs(c_acctbal - s_acctbal) < 25)"


def supplier_linkage(t: Tables) -> Linkage:
    """Customers against suppliers of their nation with about the same balance."""
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_name").alias("name"))
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"))
    gap = C.Field(lambda a, b: F.abs(a - b), "balance")
    return Linkage([B.Blocking("nation", _nation)], C.Record(("gap", gap)), lambda x: K.rule_classify(x, lambda sim: sim["gap"] < 25), c, s, "id", by_sim=True)


@query("input_match_split", f"WITH {_LINKED} SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, c_name AS name FROM customer WHERE c_custkey IN (SELECT c_custkey FROM l)")
def _(t):
    return supplier_linkage(t).matched_records


@query("input_single_split", f"WITH {_LINKED} SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM l)")
def _(t):
    return supplier_linkage(t).single_records


@query("link_customer_supplier", f"WITH {_LINKED} SELECT c_custkey AS a_id, s_suppkey AS b_id, 1.0::DOUBLE AS score FROM l")
def _(t):
    return supplier_linkage(t).matches.select(F.col("a_id.id").alias("a_id"), F.col("b_id.id").alias("b_id"), "score")


@query("link_groups", f"""
WITH RECURSIVE {_LINKED}, es AS (SELECT 'c' || c_custkey AS u, 's' || s_suppkey AS v FROM l UNION ALL SELECT 's' || s_suppkey, 'c' || c_custkey FROM l),
cc AS (SELECT u AS node, u AS r FROM es UNION SELECT es.v, cc.r FROM cc JOIN es ON es.u = cc.node), n AS (SELECT node, min(CASE WHEN r[1] = 'c' THEN r[2:]::BIGINT END) AS least FROM cc GROUP BY node)
SELECT side, id, n.least FROM (SELECT 0 AS side, c_custkey AS id, 'c' || c_custkey AS node FROM customer UNION ALL SELECT 1, s_suppkey, 's' || s_suppkey FROM supplier) x LEFT JOIN n ON n.node = x.node
""")
def _(t):
    return supplier_linkage(t).groups.select("_rid.side", "id", F.col("component.id").alias("least"))


_CUSTOMERS = "c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance, c_name AS name FROM customer"
_SUPPLIERS = "s_suppkey AS id, s_nationkey AS nation, s_acctbal AS balance, s_name AS name FROM supplier"
_UNLINKED = "u AS (SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey AND NOT abs(c_acctbal - s_acctbal) < 25)"


@query("linkage_files", f"""
WITH {_LINKED}, {_UNLINKED}
SELECT 'input-records' AS file, {_CUSTOMERS}
UNION ALL SELECT 'input-master', {_SUPPLIERS}
UNION ALL SELECT 'input-matchrows', {_CUSTOMERS} WHERE c_custkey IN (SELECT c_custkey FROM l)
UNION ALL SELECT 'input-singlerows', {_CUSTOMERS} WHERE c_custkey NOT IN (SELECT c_custkey FROM l)
UNION ALL SELECT 'match-pairs', {_CUSTOMERS} JOIN l USING (c_custkey)
UNION ALL SELECT 'match-pairs', {_SUPPLIERS} JOIN l USING (s_suppkey)
UNION ALL SELECT 'nonmatch-pairs', {_CUSTOMERS} JOIN u USING (c_custkey)
UNION ALL SELECT 'nonmatch-pairs', {_SUPPLIERS} JOIN u USING (s_suppkey)
UNION ALL SELECT 'groups', {_CUSTOMERS}
UNION ALL SELECT 'groups', {_SUPPLIERS}
UNION ALL SELECT 'InputIdx-nation', {_CUSTOMERS}
UNION ALL SELECT 'MasterIdx-nation', {_SUPPLIERS}
""")
def _(t):
    """Every record file that write_all makes, read again."""
    out = new_path(t.spark, "linkage-files")
    supplier_linkage(t).write_all(out)
    fields = ["id", "nation", "balance", "name"]

    def read(name: str) -> DataFrame:
        names = ["key", *fields] if name.endswith("Idx-nation") else None
        x = read_csv(t.spark, f"{out}/{name}.csv", fields=names)
        nation = F.col("key" if names else "nation").cast("int").alias("nation")
        return x.select(F.lit(name).alias("file"), F.col("id").cast("long"), nation, F.col("balance").cast("double"), "name")

    names = ["input-records", "input-master", "input-matchrows", "input-singlerows", "match-pairs", "nonmatch-pairs", "groups", "InputIdx-nation", "MasterIdx-nation"]
    return reduce(DataFrame.unionAll, map(read, names))


def part_dedup(part: DataFrame) -> Linkage:
    """Parts of one kind whose names are nearly equal."""
    return Linkage([part_blocks()], part_comparator(), lambda x: K.rule_classify(x, lambda s: s["name"] > 0.6), part, id_col="p_partkey", by_sim=True)


@query("dedup_part", f"{_GROUPS} SELECT p_partkey, component AS group_least FROM part LEFT JOIN comp ON node = p_partkey")
def _(t):
    return part_dedup(t.part).groups.select("p_partkey", F.col("component.id").alias("group_least"))


#: Documents are near copies from this similarity of their whole texts on.
NEAR_COPY = 0.75


def document_groups(documents: DataFrame, split: int = 1000) -> DataFrame:
    """(doc_id, group_least): copies and near copies by the whole normalised text.
    Copies are told by a hash of it, and one of each meets the others."""
    texts = documents.select("doc_id", E.alnumsp(F.col("text")).alias("text")).where("text <> ''")
    same = staged(texts.select("doc_id", F.sha2("text", 256).alias("same")), "same")
    least = same.groupBy("same").agg(F.min("doc_id").alias("a_id"), F.count("*").alias("n"))
    copies = same.join(least.where("n > 1"), "same").select("a_id", F.col("doc_id").alias("b_id")).where("a_id <> b_id")
    one = staged(texts.join(least.select(F.col("a_id").alias("doc_id")), "doc_id", "left_semi"), "one-of-each")
    counts = documents.sparkSession.sparkContext.broadcast(W.window_counts(one))
    keys = staged(W.shared_keys(one, counts, NEAR_COPY, "doc_id"), "shared-windows")
    pairs = staged(W.near_candidates(keys, NEAR_COPY, "doc_id", split), "near")
    compared = C.Record(("text", C.Field(W.window_jaccard, "text"))).compare(pairs, one, id_col="doc_id")
    edges = K.rule_classify(compared, lambda s: s["text"] >= NEAR_COPY).where("is_match").select("a_id", "b_id").unionAll(copies)
    return G.singles_and_groups(edges, documents.select("doc_id"), "doc_id").select("doc_id", F.col("component").alias("group_least"))


@query("dedup_documents", f"""
WITH RECURSIVE d AS (SELECT doc_id, string_split({_ALNUM('text')}, ' ') AS w FROM documents WHERE {_ALNUM('text')} <> ''),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 2, 1)), lambda i: array_to_string(w[i + 1:i + 3], ' '))) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
m AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k::DOUBLE / (x.n + y.n - k) >= {NEAR_COPY}),
es AS (SELECT a AS u, b AS v FROM m UNION ALL SELECT b, a FROM m), {_COMPONENTS}
SELECT doc_id, component AS group_least FROM documents LEFT JOIN comp ON node = doc_id
""")
def _(t):
    return document_groups(t.documents)
