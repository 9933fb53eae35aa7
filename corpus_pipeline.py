"""The corpus pipeline: quality classifier, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents.

Defined cases: null and empty texts are scored, grouped, mixed (with no words) and packed like
any other; rows with a null id are grouped by their texts like any other, and so are rows that repeat
an id; an empty table goes through as an empty table; extra
columns pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import mixing, packing, quality, simhash
from vitrine.llm.common import new_folder, table

#: SQL can express neither a trained network nor the fingerprints' hash.
ORACLE_SQL = None
THRESHOLD = 0.3
#: Bits within which the near-duplicate stage looks for similar texts.
WIDE_RADIUS = 7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=tuple(docs.columns), out_col="__quality")
    return scored.filter(F.col("__quality") >= THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null ids last.

    Documents link as in the operator's contract (3 bits), and also within WIDE_RADIUS bits if
    they share 0.8 or more of their five-word shingles.
    """
    return simhash.representatives(docs, wide=WIDE_RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights; a document taken twice has two rows."""
    mixed = mixing.mixed_rows(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
