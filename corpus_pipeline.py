"""From raw documents to packed training batches: five stages, each one operator over all that the last one kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir). All but the last return the columns
of `documents`. `run` writes every stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quirefold.llm.common import remainder, table
from quirefold.llm.decontamination import drop_contaminated
from quirefold.llm.langid import fit_languages, identify_languages
from quirefold.llm.line_dedup import dedup_lines
from quirefold.llm.packing import pack_documents
from quirefold.llm.simhash import drop_near_copies
from quirefold.session import stage

MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the learnt languages with at least even odds, go."""
    judged = identify_languages(docs.withColumnsRenamed(_aside(docs)), fit_languages(docs, remainder(5) != 0))
    known = (F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return judged.where(known).drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in _aside(docs).items()}).select(*docs.columns)


def _aside(docs: DataFrame) -> dict[str, str]:
    """Input columns that share a name with a result wait under another one."""
    return {c: f"_qin_{c}" for c in ("lang_pred", "score", "n_lines", "n_dropped") if c in docs.columns}


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; `n_chars` follows the text."""
    kept = dedup_lines(docs.withColumnsRenamed(_aside(docs)), min_docs=10, min_chars=1).drop("n_lines", "n_dropped")
    kept = kept.withColumnsRenamed({v: k for k, v in _aside(docs).items()})
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs, shingle=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place in the training batches."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Language ID is a trained model, which SQL cannot express: the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
