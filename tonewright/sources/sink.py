"""The incremental sink of results: parts, compaction and resuming (survey S8-S10)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewright.operators.reshape import project

REQUIRED = ("styled_text", "styled_text_style_emb", "meaning_score", "tst_result_style_sim", "bi_score", "cl_score", "gender_score",
            "entity_score", "chrf", "nat_v2", "target_keys")
STORED = ("example_number", "text", "target_style_desc", "target_style_sim_measure", *REQUIRED, "gender_activated", "naturality_score", "style_score", "score")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half(vectors: pd.Series) -> pd.Series:
    """Vectors rounded to half precision."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype=np.float16).astype(np.float32))


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, path


def exists(spark: SparkSession, folder: str) -> bool:
    fs, path = _files(spark, folder)
    return fs.exists(path)


def parts(spark: SparkSession, folder: str) -> list[str]:
    """Names of the stored parts, in order."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("part_"))


def save_results(df: DataFrame, folder: str, half_precision: bool = True) -> str | None:
    """Store ``df`` as the next part_NNNNN of a folder, gzip parquet; the part's name.

    Missing required columns are an error before anything is written. An empty frame writes no part.
    """
    spark = df.sparkSession
    out = project(df, STORED, REQUIRED)
    if half_precision:
        out = out.withColumn("styled_text_style_emb", half(F.col("styled_text_style_emb").cast("array<float>")))
    last = max((int(p.split("_")[1].split(".")[0]) for p in parts(spark, folder)), default=0)
    name = f"part_{last + 1:05d}"
    fs, path = _files(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    out.write.option("compression", "gzip").parquet(path.toString())
    if spark.read.parquet(path.toString()).isEmpty():
        fs.delete(path, True)
        return None
    target = _files(spark, f"{folder}/{name}")[1]
    fs.rename(path, target)
    return name


def read_results(spark: SparkSession, folder: str) -> DataFrame | None:
    """All parts as one frame; None when there are none."""
    names = parts(spark, folder)
    if not names:
        return None
    return spark.read.option("mergeSchema", True).parquet(*[f"{folder}/{n}" for n in names])


#: Bytes of a file of a compacted store.
FILE_BYTES = 256 << 20


def compact(spark: SparkSession, folder: str, order: str = "example_number", files: int | None = None) -> DataFrame | None:
    """All parts in one, ordered by id over its files, as many as FILE_BYTES each need. The new part is complete before an old
    one is deleted."""
    names = parts(spark, folder)
    df = read_results(spark, folder)
    if df is None or len(names) < 2:
        return df
    fs, fresh = _files(spark, f"{folder}/.compact.{uuid.uuid4().hex}")
    if files is None:
        files = 1 + sum(fs.getContentSummary(_files(spark, f"{folder}/{n}")[1]).getLength() for n in names) // FILE_BYTES
    df.repartitionByRange(files, order).sortWithinPartitions(order).write.option("compression", "gzip").parquet(fresh.toString())
    last = max(int(p.split("_")[1].split(".")[0]) for p in names)
    fs.rename(fresh, _files(spark, f"{folder}/part_{last + 1:05d}")[1])
    for n in names:
        fs.delete(_files(spark, f"{folder}/{n}")[1], True)
    return read_results(spark, folder)


def remaining(base: DataFrame, spark: SparkSession, folder: str, key: str = "example_number") -> DataFrame:
    """The rows of ``base`` that no part holds yet."""
    done = read_results(spark, folder)
    return base if done is None else base.join(done.select(key).distinct(), key, "left_anti")
