"""The thin queries over the driver's tables, and the SQL that some of them equal."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .importance import resample
from .jaccard import classes
from .language_id import identify
from .mixing import mix
from .pieces import encode
from .quality_rules import compression_bands
from .shared import new_path
from .topk import top_k
from .training_order import read_shards, write_shards
from .url_filters import PATTERNS, filter_urls
from .warc import captured

#: The host rules of op6.
HOST_RULES = ("block com/en/", "allow example.com/en/7", "allow net/de/", "block example.net/de/8", "block org/es/")
MIX_SEED = 20
#: Where the vocabulary files of public tokenizers are.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: the pre-token pattern that belongs to the byte-level BPE ranks.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captured(_read(spark, sf_dir, "pages")).drop("target_uri")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = compression_bands(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return x.select("doc_id", "verdict.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _read(spark, sf_dir, "embeddings")
    return top_k(x, x.where("vec_id % 50 = 0"), k=5)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = mix(_read(spark, sf_dir, "documents"), seed=MIX_SEED)
    return x.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules=HOST_RULES)
    return x.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(_read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    x = encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return x.select("doc_id", "pieces.n_tokens", "pieces.chunks", F.crc32("pieces.ids").alias("ids_crc32"), "pieces.round_trip")


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "training-order")
    write_shards(_read(spark, sf_dir, "documents"), path, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BPE_PATTERN)
    x = read_shards(spark, path)
    return x.select("slot", "shard", "doc_id", "window", "n_tokens", F.crc32("tokens").alias("tokens_crc32"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_topk": op4_topk,
    "op5_mixing": op5_mixing,
    "op6_url_filters": op6_url_filters,
    "op7_jaccard": op7_jaccard,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_training_order": op9_training_order,
    "op10_language_id": op10_language_id,
}

_WORDS = r"[^\x20\x09-\x0D]+"

_DIGITS, _LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base32 of a SHA-1: one letter for each five of its bits.
_BITS = "array_to_string(list_transform(range(40), lambda i: right('000' || bin(('0x' || substr(sha1(coalesce(html, '')), i + 1, 1))::INTEGER), 4)), '')"
_BASE32 = f"array_to_string(list_transform(range(32), lambda i: '{_LETTERS}'[1 + list_sum(list_transform(range(5), lambda j: substr(bits, 5 * i + j + 1, 1)::INTEGER * (16 >> j)))::INTEGER]), '')"

ORACLE = {
    "op7_jaccard": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), es AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), c AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT es.b, c.r FROM c JOIN es ON es.a = c.doc_id
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c.r) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op1_warc": f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, {_BITS} AS bits FROM pages
), d AS (
  SELECT *, min(page_id) OVER (PARTITION BY bits) AS first FROM p
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op5_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORDS}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM s
), f AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
    (sum(source_size) OVER ()
      - coalesce(sum(3 * source_size) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER (ORDER BY cap / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lv
  FROM w
), t AS (
  SELECT source, source_size, least(cap, coalesce((max(CASE WHEN lv <= cap / w THEN lv END) OVER ()) * w, cap)) AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('{MIX_SEED}:' || CASE WHEN d.source IS NULL THEN 'n' ELSE 's' || d.source END), 1, 13))::BIGINT::DOUBLE / {16**13}::DOUBLE AS u,
    (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1)::DOUBLE AS i
  FROM sized d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(u + rate * (i + 1)) - floor(u + rate * i)) * size)::BIGINT AS taken FROM r
""",
    "op6_url_filters": rf"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r(verdict, h, p) AS (
  VALUES {", ".join("('{}', '{}', '{}')".format(x.split()[0], x.split()[1].partition("/")[0], "/" + x.split()[1].partition("/")[2]) for x in HOST_RULES)}
), m AS (
  SELECT p.page_id, p.url, any_value(p.host) AS host, any_value(p.path) AS path,
    arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS rv
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  GROUP BY p.page_id, p.url
)
SELECT page_id, host, path, rule, coalesce(rv,
  CASE WHEN regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(PATTERNS)}') THEN 'block' ELSE 'allow' END) AS verdict
FROM m
""",
}
