"""Attach metadata to search results by record id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoscan.functions import names


def by_position(results: DataFrame, meta: DataFrame, originals: int) -> DataFrame:
    """Left join with the metadata row (pos, ...) at record_id mod ``originals``; nulls without one."""
    return results.withColumn("pos", F.pmod("record_id", F.lit(max(1, originals)))).join(meta, "pos", "left")


def last_by_id(meta: DataFrame) -> DataFrame:
    """One row per record_id of metadata (pos, record_id, ...): the one with the largest pos."""
    rest = [c for c in meta.columns if c != "record_id"]
    return meta.groupBy("record_id").agg(F.max_by(F.struct(*rest), "pos").alias("m")).select("record_id", *[F.col(f"m.{c}").alias(c) for c in rest])


def by_id_or_position(results: DataFrame, meta: DataFrame, count: int) -> DataFrame:
    """The metadata row with this record_id, else the one at record_id mod ``count``, as a whole row.

    ``meta`` has pos, record_id, filepath, label.  An exact row with an empty
    field isn't patched from the other.
    """
    fields = ["filepath", "label"]
    exact = last_by_id(meta).select("record_id", F.struct(*fields).alias("_exact"))
    other = meta.groupBy("pos").agg(F.max(F.struct(*fields)).alias("_other"))
    met = results.join(exact, "record_id", "left").withColumn("pos", F.pmod("record_id", F.lit(max(1, count)))).join(other, "pos", "left")
    pick = F.when(F.col("_exact").isNotNull(), F.col("_exact")).otherwise(F.col("_other"))
    return met.select(*results.columns, *[pick[f].alias(f) for f in fields])


def audio(results: DataFrame, meta: DataFrame, originals: int) -> DataFrame:
    """genre, filename and address of each result."""
    return by_position(results, meta, originals).withColumn("genre", names.genre(F.col("filename"))).withColumn("url", names.audio_url(F.col("filename")))
