"""Readers and writers for tables, models and media files."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthoscan.operators.features import Projection

MODEL_SCHEMA = "mean array<double>, std array<double>, components array<array<double>>, dims array<int>"
AUDIO_SCHEMA = "filename string, genre string"
IMAGE_SCHEMA = "record_id string, filepath string, label string"
IMAGE_PATTERN = "*.{jpg,jpeg,png,bmp,gif,webp,JPG,JPEG,PNG,BMP,GIF,WEBP}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header and a given schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def first_existing(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """The first of the CSV files that exists; an empty table if none does."""
    for path in paths:
        try:
            return read_csv(spark, path, schema)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([], schema)


def write_model(spark: SparkSession, model: Projection, dims: Sequence[int], path: str) -> None:
    """One JSON document with mean, std, components and dims."""
    row = (model.mean, model.std, model.components, [int(d) for d in dims])
    spark.createDataFrame([row], MODEL_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def read_model(spark: SparkSession, path: str) -> Projection:
    row = spark.read.schema(MODEL_SCHEMA).json(path, multiLine=True).first()
    return Projection(list(row["mean"]), list(row["std"]), [list(r) for r in row["components"]])


def parse_model(text: str) -> Projection:
    d = json.loads(text)
    return Projection(d["mean"], d["std"], d["components"])


def media_files(spark: SparkSession, root: str, pattern: str = IMAGE_PATTERN, per_class: int | None = None) -> DataFrame:
    """path, class (the folder's name) and content of media files below ``root``; with ``per_class`` the first so many by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    files = files.withColumn("class", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    if per_class is None:
        return files.select("path", "class", "content")
    from orthoscan.operators.ranks import top_per_group

    chosen = top_per_group(files.select("path", "class"), "class", ["path"], per_class)
    return files.join(chosen.select("path"), "path", "left_semi").select("path", "class", "content")


def extract_features(files: DataFrame, extractor, dims: int) -> DataFrame:
    """path, features by ``extractor``, a callable from a list of bytes to rows of ``dims`` floats, called once a batch.

    Content that it can't read may be given as None and becomes zeros.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = extractor(list(batch["content"]))
            yield pd.DataFrame({"path": batch["path"], "features": [[float(x) for x in (r if r is not None else [0.0] * dims)] for r in rows]})

    return files.select("path", "content").mapInPandas(run, "path string, features array<float>")
