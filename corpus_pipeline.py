"""From raw documents to a mixed training corpus in five stages, each one operator of tessera.llm.

A stage gets what its predecessor kept and returns what it keeps; all but the last return the columns
of documents. Rows without doc_id pass the near-duplicate stage; null texts fail the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import op3_quality, op6_neardup, op7_decontaminate, op9_toxicity, op10_mixing
from tessera.llm.runtime import cut, read, unused

#: SQL can't express the model, signature and matching stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base limits and the rule cascade.

    Null and empty texts go, as they have no words; of repeated rows each is judged on its own; an empty table gives none;
    further columns pass, whatever their names.
    """
    return op3_quality.kept_only(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below the threshold.

    A null or empty text has the severity that no words have; without labels, or with one grade only, no document goes;
    repeated rows are scored each on its own; further columns pass, whatever their names.
    """
    out = unused(docs, "toxicity")
    scored = op9_toxicity.score(docs, read(spark, sf_dir, "labels"), out=out)
    return scored.where(F.col(f"{out}.severity") < op9_toxicity.THRESHOLD).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id.

    Rows without doc_id or text stay, as they are compared with nothing; of rows that repeat one document one stays;
    different texts with one doc_id are judged each on its own; further columns pass, whatever their names.
    """
    return op6_neardup.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts stay; an empty benchmark lets all stay; repeated rows are judged each on its own; further
    columns pass, whatever their names.
    """
    out = unused(docs, "leaks")
    marked = op7_decontaminate.mark(docs, read(spark, sf_dir, "benchmark"), out=out)
    return marked.where(F.size(out) == 0).select(*_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: op10's columns instead of those of documents.

    Null texts have size 0; null is a source, the last; an empty table gives no rows.
    """
    return op10_mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over documents; every stage's rows are written before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
