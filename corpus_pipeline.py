"""The corpus pipeline: language ID, exact dedup, near-dedup, surrogates for personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All stages but the last
return the columns they are given.

Defined cases. A null text has no language and goes with the first stage, as do texts without a letter; a null doc_id
is smaller than any other in exact dedup and larger than any other in near-dedup; rows equal in all columns leave one
row; an empty table passes all stages empty; further columns of any name and type are carried up to the packing, which
returns its own columns; long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.bloomdedup import exact_dedup as keep_one_of_equals
from kinweave.llm.dartminhash import drop_near_duplicates
from kinweave.llm.langid import UNKNOWN, held_out, predict, train
from kinweave.llm.packing import pack
from kinweave.llm.surrogates import replace_personal_data, session_key
from kinweave.llm.tokens import free_name
from kinweave.sources.tables import table
from kinweave.staging import drop_staged, stage, temporary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go: no text, no letter in it, or likelier at random than in any learned language.

    Where no document has a language to learn from, all texts with a letter stay.
    """
    model = train(docs.where(~held_out()))
    if not model[0]:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    lang, score, evidence = (free_name(docs, c) for c in ("lang_pred", "score", "evidence"))
    found = predict(docs, model, evidence=True)
    return found.where((F.col(lang) != UNKNOWN) & (F.col(evidence) > 0)).drop(lang, score, evidence)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return keep_one_of_equals(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates; n_chars follows the new text."""
    counted = free_name(docs, "replaced")
    done = replace_personal_data(docs, session_key(spark))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(counted) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.drop(counted)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece, with its token ids."""
    return pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("surrogates", surrogates), ("best_fit_packing", best_fit_packing)]

#: SQL cannot express the classifier, the sketches or the tokenizers; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the table documents; each is written as Parquet and read again."""
    docs, path = table(spark, sf_dir, "documents"), ""
    for name, stage_function in STAGES:
        before = path
        # what a stage has staged for itself goes when its result is written, and so does the input of the stage
        with temporary(spark, lambda: path):
            docs, path = stage(stage_function(spark, docs, sf_dir), name)
        if before:
            drop_staged(spark, before)
    return docs
