"""Readers of test frames, centroids, news and training files (survey S1-S7, P14)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least length of a float entry of an archive that counts as a vector.
VECTOR = 50


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A test frame from parquet (any compression), with an explicit example_number where the file has none."""
    df = spark.read.parquet(path)
    if "example_number" in df.columns:
        return df
    index = next((c for c in df.columns if c.startswith("__index_level_")), None)
    return df.withColumnRenamed(index, "example_number") if index else df.withColumn("example_number", F.xxhash64(*df.columns))


def read_centroids(spark: SparkSession, path: str, renormalise: bool = False) -> DataFrame:
    """(style, centroid) from a numpy archive: float entries of one dimension and 50 values or more, scaled to norm 1 on
    request. Other entries are metadata and left out."""
    rows = []
    with np.load(path, allow_pickle=False) as archive:
        for name in archive.files:
            v = archive[name]
            if v.ndim >= 1 and v.size >= VECTOR and np.issubdtype(v.dtype, np.floating):
                v = v.astype(np.float64).ravel()
                length = float(np.linalg.norm(v))
                rows.append((name, (v / length if renormalise and length else v).tolist()))
    return spark.createDataFrame(rows, "style string, centroid array<double>")


def read_scored_answers(spark: SparkSession, path: str, schema: str | T.StructType | None = None, model: str | None = None) -> DataFrame:
    """Scored answers from CSV (gzip by its name), of one model on request; give a schema in production."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.filter(F.col("llm") == model) if model is not None else df


def read_news(spark: SparkSession, paths: str | Sequence[str], author: str = "News") -> DataFrame:
    """News pairs (text_ru, text_ru_pph) from CSV files, gzip by their names, with a literal author."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema("text_ru string, text_ru_pph string")
    return reader.csv(paths if isinstance(paths, str) else list(paths)).withColumn("author", F.lit(author))


def read_training(spark: SparkSession, paths: str | Sequence[str], processing=None, seed: int | None = None, n_epochs: int = 1, key: Sequence[str] = ()) -> DataFrame:
    """Training rows of one or more parquet files, with the file and its place in the cycle.

    ``processing`` maps DataFrames. With a seed, rows carry epoch and position_key: order by file_no, epoch and
    position_key for the sequential cycle. Every pass over a file uses the same seeds.
    """
    from tonewright.operators.sampling import epochs

    names = [paths] if isinstance(paths, str) else list(paths)
    out = None
    for i, name in enumerate(names):
        part = spark.read.parquet(name)
        part = part.transform(processing) if processing else part
        if seed is not None:
            part = epochs(part, n_epochs, seed, *(key or part.columns))
        part = part.withColumn("file_no", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
