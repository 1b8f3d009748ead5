"""Cleaning a corpus of documents for training, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all that the stage before it kept and returns
a DataFrame, which ``run`` writes to the shared folder and reads again. All but the last
return the columns of ``docs``.

Rows that are equal in all columns are kept once by the deduplicating stages. Null texts are
empty, null ids and sources are treated as the operators say, further columns pass through,
and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorwatch.llm import exact_dedup, jaccard, mixing, packing, toxicity
from rotorwatch.llm.queries import OTHERS, REST_WEIGHT, WEIGHTS, toxicity_model
from rotorwatch.llm.rows import ROW, keyed, same_row
from rotorwatch.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models don't take for toxic."""
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, that of the largest id."""
    kept = materialize(exact_dedup.exact_groups(docs).where("kept"), "kept")
    return exact_dedup.keep_rows(docs, kept)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, directly or over others, that of the smallest id."""
    kept = materialize(jaccard.near_duplicates(docs).where("first"), "kept")
    return exact_dedup.keep_rows(docs, kept)


def _in_mix(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_ll_position``, the place in the mix. It follows from the rows alone, so every
    stage that works on the same documents finds the same places."""
    placed = mixing.mix(docs, WEIGHTS, REST_WEIGHT, others=OTHERS).groupBy(*ROW)  # rows that repeat stand together
    order = materialize(placed.agg(F.min("position").alias("_ll_position")), "mix")
    return same_row(keyed(docs), order)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: files by range of position, sorted within."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mixed = _in_mix(docs)
    return mixed.repartitionByRange(parts, "_ll_position").sortWithinPartitions("_ll_position").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of at most 1024 tokens that are numbered in the
    order of the mix. Splits of files have no order, so places in the mix are worked out again."""
    return packing.pack(_in_mix(docs), order_col="_ll_position")


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard", drop_near_copies),
    ("pfair_mix", mix_sources), ("best_fit_packing", pack_sequences),
]

#: A trained model decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
