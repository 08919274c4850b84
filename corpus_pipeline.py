"""The training-data pipeline: documents through five stages of ``orrery.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
before the next one. All but the last return the columns of ``documents``.

Every stage takes an empty table (no rows), nulls in any column, empty and very long texts, repeated rows and ids, and
further columns, whose names may be those of columns that its operator adds; these come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, mixing, ngram_join, substring_dedup, toxicity
from orrery.llm.queries import MIX_WEIGHTS
from orrery.llm.scratch import Scratch, table


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _keeping(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``stage`` over ``docs`` with further columns under names that no operator adds, then as they were."""
    other = {c: f"further column {i}" for i, c in enumerate(docs.columns) if c not in DOCUMENT}
    out = stage(docs.withColumnsRenamed(other))
    return out.select(*(F.col(f"`{other.get(c, c)}`").alias(c) for c in docs.columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. A null or empty text has no hit and stays; a null id is no obstacle."""
    return _keeping(docs, lambda d: toxicity.reject_toxic(d, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest id.

    Texts without words and rows with a null id stay; of rows that repeat an id all stay or none.
    """
    return _keeping(docs, ngram_join.keep_one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier in the corpus go; a text without them stays as it is, a null one null.

    Null ids come after all others.
    """

    def cut(d):
        out = substring_dedup.remove_repeats(d)
        text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
        size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        return out.withColumns({"text": text, "n_chars": size})

    return _keeping(docs, cut)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by target weights; a row comes as often as its epochs say (twice at most).

    Null languages and sources are leaves of their own; texts without words hold no tokens, and stay out if their leaf
    has none to give. Null ids are rows like others.
    """

    def mixed(d):
        out = mixing.mix(d, MIX_WEIGHTS, budget_share=(4, 5), max_epochs=2, seed=17)
        return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))

    return _keeping(docs, mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (null: none), with digests of the ids and of the text decoded from them."""
    import public_tokenizers

    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The classifier of the first stage has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        done = docs
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs, name)
            if k:
                scratch.drop(done)
    return docs
