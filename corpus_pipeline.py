"""Corpus pipeline over `documents`: five stages, each on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`.  run() writes each stage's rows as Parquet to the shared folder and reads them again, so that a
lost executor costs a stage at most.

Defined results of every stage: an empty table gives no rows; extra columns, clashing names included, and
nulls in them pass through; null doc_ids are rows like others; a text of any length is judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronogrid.llm import decontamination, language_id, line_dedup, mixing, near_dedup
from chronogrid.llm.common import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compressors settle; rejected ones go.

    Null and letterless texts are rejected; equally small totals are too narrow a margin; repeated rows are
    judged alike.
    """
    return language_id.drop_rejected(docs)


def remove_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without cross-site boilerplate lines; documents of which no word is left go.

    n_chars follows the text where lines went.  Null and empty texts, of which nothing is removed, stay; the
    first of equally early occurrences is that of the smaller doc_id, and all rows of a repeated first row stay.
    """
    own = {c: f"__own_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    cleaned = line_dedup.line_dedup(docs.withColumnsRenamed(own))
    empty = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    length = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    kept = cleaned.where(~F.coalesce(empty, F.lit(False))).withColumns(length)
    return kept.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest doc_id.

    Null and wordless texts and rows without a doc_id stay; equal rows are kept once.
    """
    return near_dedup.deduplicate(docs).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null texts hold none; an alignment that just reaches the least score counts; repeated rows are judged alike.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document left.

    Null texts have size 0, a null source is one of its own, and repeated rows are taken separately.
    """
    return mixing.mix_sources(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", remove_boilerplate_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_to_targets),
]

#: The stages learn, sketch and draw: SQL cannot express them. tests/llm has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
