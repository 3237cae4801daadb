"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its
predecessor kept; its result is stored as Parquet and read again. Extra columns
stay as they are up to the last stage; an empty table gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from minpairs.llm import classifier, common, exact, minhash, mixing, packing, queries


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 0 go. Null and empty texts are scored
    like others; no labels: a constant score, all documents stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.keep_good(docs, classifier.train_on(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (null texts are equal to empty
    ones; of repeated rows one stays; rows without an id go if one with an id is equal)."""
    return exact.keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (80 % of the shingles shared) the document with the least doc_id stays.
    Documents without words, and rows without an id, are linked with nothing and stay."""
    return minhash.keep_representatives(docs, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources at their target weights, over at most two epochs;
    the budget is as many tokens as there are. A document occurs once per epoch it is in; null
    languages and sources are names of their own, documents without words go."""
    return mixing.mix(docs, weights=queries.MIX_WEIGHTS, domain=queries.mix_domain(), share=1.0, max_epochs=2, seed=17).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of 2048 ids; every row is packed on its own, whatever its id."""
    import public_tokenizers

    # workers live on from stage to stage, next to what the others hold: a smaller memory than the operator's own
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=250_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("mix_sources", mix_stage),
    ("pack", pack_stage),
]

ORACLE_SQL = None  # the classifier has no SQL form; tests hold run() against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = common.scratch_path(spark, f"pipeline_{name}")
        with common.scratch_scope(spark):  # a stage's own tables go once its result is stored
            docs = common.stage(stage(spark, docs, sf_dir), name, kept)
    return STAGES[-1][1](spark, docs, sf_dir)
