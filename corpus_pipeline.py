"""Prepare a training corpus: from the documents table to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each works on
all that the one before kept.  All but the last return the columns of
``documents``.

Throughout: a null text is an empty one and stays null, texts are read whole
however long, rows that repeat are each kept or dropped as the stage says, other
columns pass through whatever their names, and an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.llm import decontaminate, line_dedup, packing, quality, similar
from orthoscan.llm.common import id_remainder, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labelled rows outside its held-out fold.

    Empty texts are scored like others.  Rows of one doc_id, null ones too, stay
    or go together, by their best score.  Without labelled rows all stay.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), 4) != 2)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in the last of them only; n_chars follows the text.

    No row goes, and an empty text has one empty line, which stays.  Rows of one
    doc_id count as one document; a null doc_id comes before all others.
    """
    length = F.when(F.col("n_dropped") > 0, F.char_length("row.text").cast("long")).otherwise(F.col("row.n_chars"))
    return line_dedup.dedup_rows(docs).select([length.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: Jaccard similarity of 0.8 or more on five-word shingles, every such pair.

    Pairs are found by SimHash bytes posted by position and counted, and compared on their whole sets.
    The one with the smallest doc_id stays; rows that share it all stay.  Texts
    without words are one group.  Null doc_ids stay only in groups of nothing else.
    """
    return similar.near_dedup(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, verbatim or re-parameterised, go.

    Empty texts hold none, and without benchmark items all documents stay.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences; an empty text is its end token."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: A trained classifier, XXH64 and a tokenizer have no SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
