"""Selection, filters and set operations over results (survey A1-A3, A8-A10, F4-F8, F11, J1-J9, O1-O6, U1-U3)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Overlapping sets of styles for final figures.
STYLE_SETS = {
    "DT": ["Dostoevsky", "Tolstoy"],
    "BCDT": ["Bible", "Chekhov", "Dostoevsky", "Tolstoy"],
    "COMPLETE": ["Bible", "Chekhov", "Dostoevsky", "Tolstoy", "News"],
}


def valid_scores(df: DataFrame, score: str) -> DataFrame:
    """Rows whose score is a number; text that is none counts as missing."""
    value = F.col(score).try_cast("double")
    return df.withColumn(score, value).filter(value.isNotNull() & ~F.isnan(value))


def best_version(df: DataFrame, score: str = "score", keys: Sequence[str] = ("example_number", "target_style"), position: Sequence[str] = ("version_number",)) -> DataFrame:
    """The row of the highest score of each group, the first by ``position`` among equals.

    Null and NaN scores are no candidates and null keys no groups. ``row_number() = 1`` lets Catalyst keep one row per
    group and task before the shuffle, so a hot group costs no more than another.
    """
    rows = valid_scores(df, score)
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    order = W.partitionBy(*keys).orderBy(F.col(score).desc(), *[F.col(p).asc_nulls_last() for p in position])
    return rows.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def final_performance(best: DataFrame, score: str = "score", sets: Mapping[str, Sequence[str]] = STYLE_SETS, style: str = "target_style", requested: Sequence[str] | None = None) -> DataFrame:
    """(style_set, mean_score, n): the mean score of each set of styles; sets may overlap. A set shows only when all
    its styles were requested; an empty selection gives null."""
    shown = {n: list(s) for n, s in sets.items() if requested is None or set(s) <= set(requested)}
    if not shown:
        return best.agg(F.avg(score).alias("mean_score"), F.count(score).alias("n")).select(F.lit("DATA_MEAN").alias("style_set"), "mean_score", "n")
    members = F.array(*[F.when(F.col(style).isin(s), F.lit(n)) for n, s in shown.items()])
    rows = best.select(F.explode(F.filter(members, lambda m: m.isNotNull())).alias("style_set"), score)
    means = rows.groupBy("style_set").agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))
    names = best.sparkSession.createDataFrame([(n,) for n in shown], "style_set string")
    return F.broadcast(names).join(means, "style_set", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


#: Limits of the keep mask: column, comparison, limit.
KEEP = (
    ("chrf", "<", 0.75), ("bi_score", "<", 0.12), ("cl_score", "<", 0.10), ("entity_score", ">=", 0.70), ("meaning_score", ">", 0.75),
    ("tst_result_style_sim", "<", 0.92), ("nat_v2", ">=", 0.75),
)
GENDER_LIMIT = 0.70


def keep_mask(df: DataFrame, strict: bool = True) -> Column:
    """One boolean: all limits hold, and the gender score where it was activated.

    A missing column is an error at once. NaN or null in a column that counts is an error at run time when
    ``strict`` (NaN would pass ``>=``); the gender score may be missing where it was not activated.
    """
    needed = [c for c, _, _ in KEEP] + ["gender_score", "gender_activated"]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError(f"columns missing for the keep mask: {missing}")
    active = F.col("gender_activated")
    bad = active.isNull() | (active & (F.col("gender_score").isNull() | F.isnan("gender_score")))
    ok = ~(active & (F.col("gender_score") < GENDER_LIMIT))
    for name, sign, limit in KEEP:
        c = F.col(name)
        bad = bad | c.isNull() | F.isnan(c)
        ok = ok & {"<": c < limit, ">": c > limit, ">=": c >= limit}[sign]
    if strict:
        return F.when(bad, F.raise_error(F.lit("missing score in the keep mask")).cast("boolean")).otherwise(ok)
    return F.when(bad, F.lit(None).cast("boolean")).otherwise(ok)


def near_target(df: DataFrame, similarity: str = "target_style_sim_measure", limit: float = 0.9) -> DataFrame:
    """Rows whose target is far enough from the source."""
    return df.filter(F.col(similarity) < limit)


def pass_rate(df: DataFrame, keep: Column, *by: str) -> DataFrame:
    """(*by, tried, succeeded, rate)"""
    return df.groupBy(*by).agg(F.count("*").alias("tried"), F.count_if(keep).alias("succeeded")).withColumn("rate", F.try_divide("succeeded", "tried"))


def shares(df: DataFrame, weight: str, by: Sequence[str], out: str = "share") -> DataFrame:
    """Weights over the sum of their group, joined from a pre-aggregated table so that no group is gathered."""
    sums = df.groupBy(*by).agg(F.sum(weight).alias("_sum"))
    joined = df.join(sums, list(by)) if by else df.crossJoin(F.broadcast(sums))
    return joined.withColumn(out, F.try_divide(weight, F.col("_sum"))).drop("_sum")


def with_centroids(df: DataFrame, styles: DataFrame, style: str = "target_style", checked: bool = True) -> DataFrame:
    """Join each row's target centroid from a table (style, centroid) of author styles.

    The table is a setting, one row per style; an unknown style is an error at run time when ``checked``, else null.
    """
    table = styles.select(F.col("style").alias(style), "centroid")
    joined = df.join(table, style, "left")
    if checked:
        problem = F.raise_error(F.concat(F.lit("no centroid for style "), F.coalesce(style, F.lit("null")))).cast("array<float>")
        joined = joined.withColumn("centroid", F.coalesce("centroid", problem))
    return joined


def group_centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid): the normalised mean of unit vectors per key, by (key, dimension) so that no vector list is built."""
    from tonewright.functions.vector import normalised

    parts = df.select(key, F.posexplode(normalised(vector)).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("parts"))
    return rows.select(key, normalised(F.transform("parts", lambda p: p["x"])).alias("centroid"))


def without(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``done``; a null key is in neither and stays."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def unknown_ids(results: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Ids of the results that no source has."""
    return results.select(key).distinct().join(sources.select(key), key, "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def memoised(df: DataFrame, key: str, compute, out: str) -> DataFrame:
    """``compute`` (DataFrame of distinct keys to key and ``out``) run once per distinct value and joined back.

    Null keys keep a null result.
    """
    table = compute(df.select(key).filter(F.col(key).isNotNull()).distinct())
    return df.join(table.select(key, out), key, "left")


def head(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The first ``n`` rows of an order: a feature, not a sample."""
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """A permutation by row hash, the same for any partitioning."""
    from tonewright.functions.vector import uniform

    return df.orderBy(uniform(seed, *key), *key)
