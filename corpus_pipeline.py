"""The corpus pipeline: documents to encoded training text in five stages.

Each stage works on all that the one before kept, written as Parquet in the
shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.llm.importance import selected_documents
from linkweave.llm.jaccard import one_of_each
from linkweave.llm.mixing import mixed_documents
from linkweave.llm.pieces import encode
from linkweave.llm.quality_rules import keep_good
from linkweave.llm.queries import MIX_SEED, TOKENIZERS
from linkweave.llm.shared import staged


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good text selects."""
    return selected_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base counts and compression bands keep."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs, seed=MIX_SEED)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with piece_ids (binary, uint16), n_tokens and round_trip."""
    x = encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model")
    return x.select(*docs.columns, F.col("pieces.ids").alias("piece_ids"), "pieces.n_tokens", "pieces.round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding", pieces),
]

#: The classifier, the compression ratios and the encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
