"""Fan-out of sources to styled versions, and back (survey R1-R6, F1-F3, F10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.functions.vector import let

#: Columns of a source that survive the fan-out of versions.
KEPT = ("example_number", "text", "author", "target_style", "target_style_desc", "target_keys", "target_style_emb",
        "target_style_sim_measure", "text_perplexity", "text_style_emb", "text_labse_emb", "tst_model")


#: Most target styles of a fan-out.
MOST_STYLES = 10_000


def project(df: DataFrame, wanted: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """The columns of ``wanted`` that ``df`` has; an error when one of ``required`` is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise KeyError(f"required columns missing: {missing}")
    return df.select(*[c for c in wanted if c in df.columns])


def other_styles(df: DataFrame, styles: DataFrame, author: str = "author", style: str = "target_style") -> DataFrame:
    """Every source with every style but its author's own; sources without an author get all.

    ``styles`` is a table of one row a style; more than ``MOST_STYLES`` different ones are an error, so that what is broadcast
    is bounded.
    """
    names = styles.select(F.col(styles.columns[0]).alias(style)).distinct()
    if names.limit(MOST_STYLES + 1).count() > MOST_STYLES:
        raise ValueError(f"more than {MOST_STYLES} target styles")
    return df.crossJoin(F.broadcast(names)).filter(~F.col(author).eqNullSafe(F.col(style)))


def expand_versions(df: DataFrame, versions: str, styled: str = "styled_text", kept: Sequence[str] = KEPT, ragged: str = "error", expected: int | None = None) -> DataFrame:
    """One row per version of an ``array<string>`` column, numbered from 0.

    Lists of different lengths are an error, unless ``ragged`` is "allow". With ``expected`` each list is held against this
    length as it passes; without, the lists are materialised first, so that the model behind them runs once, and compared at
    once. A null list gives no rows.
    """
    columns = [c for c in kept if c in df.columns]
    source = df
    if ragged == "error":
        size, wrong = F.size(versions), "versions have different lengths"
        if expected is not None:
            failed = F.raise_error(F.lit(wrong)).cast(df.schema[versions].dataType)
            held = let(F.col(versions), lambda v: F.when(v.isNull() | (F.size(v) == expected), v).otherwise(failed))  # named once: the model behind it runs once
            source = df.withColumn(versions, held)
        else:
            from tonewright.session import cut

            source = cut(df)
            low, high = source.filter(F.col(versions).isNotNull()).agg(F.min(size), F.max(size)).first()
            if low != high:
                raise ValueError(wrong)
    # the outer form, as Spark would filter by the size of an inner one's lists, and run the model behind them for that again
    return source.select(*columns, F.posexplode_outer(versions).alias("version_number", styled)).filter("version_number is not null")


def single_version(df: DataFrame, styled: str = "styled_text") -> DataFrame:
    """A column of single answers as version 0; every column survives."""
    return df.withColumn("version_number", F.lit(0)).withColumn(styled, F.col(styled))


def both_directions(df: DataFrame, forward: str = "styled_text_style_emb", back: str | None = "text_style_emb") -> DataFrame:
    """Training pairs (source, target, style, direction): text to styled, and styled to text where ``back`` is given."""
    forth = F.struct(F.col("text").alias("source"), F.col("styled_text").alias("target"), F.col(forward).alias("style"), F.lit(1).alias("direction"))
    pairs = [forth]
    if back is not None:
        pairs.insert(0, F.struct(F.col("styled_text").alias("source"), F.col("text").alias("target"), F.col(back).alias("style"), F.lit(0).alias("direction")))
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def regroup(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str = "versions") -> DataFrame:
    """Lists of ``value`` per group in the order of ``order``; a group's versions are few."""
    sorted_ = F.array_sort(F.collect_list(F.struct(order, value)))
    return df.groupBy(*keys).agg(F.transform(sorted_, lambda s: s[value]).alias(out))


def source_options(columns: Sequence[str]) -> Column:
    """The non-empty ones of several source columns, as an array of (name, text)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("text")) for c in columns])
    return F.filter(pairs, lambda p: p["text"].isNotNull() & (p["text"] != ""))


def default_option(columns: Sequence[str]) -> Column:
    return F.try_element_at(source_options(columns), F.lit(1))
