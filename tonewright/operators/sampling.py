"""Seeded sampling of targets, lengths and mixes (survey P1-P5, P12, P13, A5, A9, A11, J3, J4).

Random numbers are hashes of (seed, row, purpose), so every draw is the same for any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonewright.functions.scores import domain_similarity, domain_weights, target_styles
from tonewright.functions.vector import as_double, mixed, negated, noisy, rescaled, uniform

#: Most keys that may have a weight of their own; a table of weights is a setting.
MOST_WEIGHTS = 1_000
#: Rows of a key that one window numbers.
NUMBERED = 1 << 16


def pool_index(pool: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(_key, _ordinal, _vector): the vectors of a pool with their number in their key; and (_key, _n, _at): the keys with how
    many vectors they have and their own number. Null keys and vectors are left out.

    Numbers follow a hash of the vector, or of the key. Both are counted in hash ranges of about NUMBERED rows first, so
    that no task numbers a whole hot key or all keys.
    """
    rows = pool.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("string").alias("_key"), as_double(vector).alias("_vector"))
    counts = rows.groupBy("_key").agg(F.count("*").alias("_n"))
    ranges = F.ceil(F.col("_n") / NUMBERED)
    sized = rows.join(counts, "_key").withColumn("_range", F.floor(uniform(3, "_vector") * ranges))
    indexed = numbered(sized, ["_key"], "_range", [F.xxhash64("_vector")], "_ordinal").select("_key", "_ordinal", "_vector")
    keys = numbered(counts.withColumn("_range", F.floor(uniform(5, "_key") * 64)), [], "_range", [F.col("_key")], "_at")
    return indexed, keys.select("_key", "_n", "_at")


def draw_targets(
    df: DataFrame, pool: DataFrame, key: str, id_col: str, n_picks: int = 1, vector: str = "text_style_emb", seed: int = 1991,
    target_norm: float | None = None, weights: DataFrame | None = None, extra: Sequence[str] = (),
) -> DataFrame:
    """``df`` plus target_keys and target_style_emb: ``n_picks`` other keys of the pool, one vector of each, mixed.

    Keys differ from the row's own (from none for a null key; from none either when there is no other) and from each other,
    or are drawn with replacement when there are too few. All keys are alike, or have the weights of a table (key,
    weight) of at most ``MOST_WEIGHTS`` rows, beside which no other key is drawn while one has a weight. The mixture is
    rescaled to ``target_norm`` or to the source's norm. An empty pool gives nulls.

    A draw is a number among the keys that are left, which a join turns into a key, and then a number among the vectors of that
    key, which another join turns into a vector. No row carries the keys.
    """
    indexed, keys = pool_index(pool, key, vector)
    parts = [id_col, *extra]
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(key).cast("string").alias("_own"), *[F.col(c).alias(f"_p_{i}") for i, c in enumerate(parts)])
    ids = [F.col(f"_p_{i}") for i in range(len(parts))]
    if weights is None:
        rows = _even_draws(rows, keys, ids, n_picks, seed)
    else:
        rows = _weighted_draws(rows, keys, weights, ids, n_picks, seed)
    for p in range(n_picks):
        one = keys.select(F.col("_at").alias("_drawn"), F.col("_key").alias(f"_k{p}"), F.col("_n").alias("_of"))
        rows = rows.withColumn("_drawn", F.get("_picks", F.lit(p))).join(one, "_drawn", "left").drop("_drawn")
        ordinal = F.floor(uniform(seed + 10 + p, *ids, f"_k{p}") * F.col("_of"))
        rows = rows.withColumn("_nth", ordinal).drop("_of")
        them = indexed.select(F.col("_key").alias(f"_k{p}"), F.col("_ordinal").alias("_nth"), F.col("_vector").alias(f"_v{p}"))
        rows = rows.join(them, [f"_k{p}", "_nth"], "left").drop("_nth")
    vectors = F.array(*[F.col(f"_v{p}") for p in range(n_picks)])
    shares = F.array(*[uniform(seed + 20 + p, *ids) for p in range(n_picks)])
    combined = F.col("_v0") if n_picks == 1 else F.when(F.forall(vectors, lambda v: v.isNotNull()), mixed(vectors, shares))
    names = F.when(F.col("_k0").isNotNull(), F.array(*[F.col(f"_k{p}") for p in range(n_picks)]))
    out = rows.select("_row.*", names.alias("target_keys"), combined.alias("_combined"))
    return out.withColumn("target_style_emb", rescaled("_combined", vector, target_norm)).drop("_combined")


def _even_draws(rows: DataFrame, keys: DataFrame, ids: Sequence[Column], n_picks: int, seed: int) -> DataFrame:
    """``rows`` with _picks: numbers of keys, each drawn evenly from those that are left."""
    total = keys.agg(F.count("*").alias("_all"))  # one row
    rows = rows.join(keys.select(F.col("_key").alias("_own"), F.col("_at").alias("_not")), "_own", "left").crossJoin(F.broadcast(total))
    alone = (F.col("_all") == 1) & F.col("_not").isNotNull()
    out = F.when(F.col("_not").isNotNull() & ~alone, F.array("_not")).otherwise(F.array().cast("array<long>"))
    rows = rows.withColumn("_out", out).withColumn("_left", F.col("_all") - F.size("_out"))
    enough = F.col("_left") >= n_picks
    for p in range(n_picks):
        # the drawn number counts over the keys that are out, from the smallest on
        n = F.col("_left") - F.when(enough, p).otherwise(0)
        drawn = F.floor(uniform(seed + p, *ids) * n)
        barred = F.when(enough, F.col("_out")).otherwise(F.slice("_out", 1, F.size("_out") - p))
        place = F.aggregate(F.array_sort(barred), drawn, lambda at, x: at + F.when(at >= x, 1).otherwise(0))
        rows = rows.withColumn("_out", F.concat("_out", F.array(F.when(n > 0, place))))
    return rows.withColumn("_picks", F.slice("_out", F.size("_out") - n_picks + 1, n_picks)).drop("_out", "_left", "_all", "_not")


def _weighted_draws(rows: DataFrame, keys: DataFrame, weights: DataFrame, ids: Sequence[Column], n_picks: int, seed: int) -> DataFrame:
    """``rows`` with _picks: numbers of keys by exponential races among the few keys that have a weight."""
    table = weights.toDF("_key", "_w").filter("_w > 0").limit(MOST_WEIGHTS + 1)
    if table.count() > MOST_WEIGHTS:
        raise ValueError(f"more than {MOST_WEIGHTS} weights")
    known = keys.join(F.broadcast(table), "_key")
    if known.isEmpty():
        return _even_draws(rows, keys, ids, n_picks, seed)
    row = known.agg(F.array_sort(F.collect_list(F.struct("_key", "_at", "_w"))).alias("_known"))
    rows = rows.crossJoin(F.broadcast(row))  # one row of at most MOST_WEIGHTS keys
    others = F.filter("_known", lambda k: ~k["_key"].eqNullSafe(F.col("_own")))
    rows = rows.withColumn("_from", F.when(F.size(others) > 0, others).otherwise(F.col("_known")))
    race = lambda s: F.array_sort(F.transform("_from", lambda k: F.struct((-F.log(uniform(s, *ids, k["_key"])) / k["_w"]).alias("t"), k["_at"].alias("at"))))
    first = F.transform(F.slice(race(seed), 1, n_picks), lambda k: k["at"])
    again = F.array(*[F.get(race(seed + 100 + p), F.lit(0))["at"] for p in range(n_picks)])
    return rows.withColumn("_picks", F.when(F.size("_from") >= n_picks, first).otherwise(again)).drop("_known", "_from")


def with_target_kind(df: DataFrame, domain: str, id_col: str, seed: int, extra: Sequence[str] = (), has_author_targets: bool | None = None) -> DataFrame:
    """``df`` plus target_style_desc: a uniform choice among the kinds its domain may get."""
    from tonewright.functions.scores import DOMAIN_ONLY

    full, short = (F.array(*[F.lit(s) for s in target_styles("", flag)]) for flag in (True, False))
    if has_author_targets is None:
        options = F.when(F.coalesce(F.col(domain).isin(DOMAIN_ONLY), F.lit(False)), short).otherwise(full)
    else:
        options = full if has_author_targets else short
    at = F.floor(uniform(seed + 30, id_col, *extra) * F.size(options)).cast("int")
    return df.withColumn("target_style_desc", F.get(options, at))


def add_targets(
    df: DataFrame, domain_pool: DataFrame, author_pool: DataFrame, id_col: str, seed: int = 1991, target_norm: float | None = None,
    source_domain: str | None = None, extra: Sequence[str] = (),
) -> DataFrame:
    """Targets by kind: another author or domain, or a mix of two, then noise or negations; keys name what was drawn.

    Weights by nearness apply to single domains only. An unknown kind is an error at run time.
    """
    kind = F.col("target_style_desc")
    weights = None
    if source_domain:
        table = domain_weights(domain_similarity(df.sparkSession)).filter(F.col("source") == source_domain).select("target", "weight")
        weights = None if table.isEmpty() else table  # a domain that the table lacks has no preferences
    known = None
    out = None
    for name, pool, key, picks, w in (
        ("other_author", author_pool, "author", 1, None), ("2_authors_weighted_avg", author_pool, "author", 2, None),
        ("other_domain", domain_pool, "domain", 1, weights), ("2_domains_weighted_avg", domain_pool, "domain", 2, None),
    ):
        is_kind = kind.contains(name)
        part = draw_targets(df.filter(is_kind), pool, key, id_col, picks, seed=seed, target_norm=target_norm, weights=w, extra=extra)
        out = part if out is None else out.unionByName(part)
        known = is_kind if known is None else known | is_kind
    strange = df.filter(~F.coalesce(known, F.lit(False)))
    failed = F.raise_error(F.concat(F.lit("unknown target kind "), F.coalesce(kind, F.lit("null"))))
    strange = strange.select(*df.columns, failed.cast("array<string>").alias("target_keys"), failed.cast("array<double>").alias("target_style_emb"))
    out = out.unionByName(strange)
    v = F.col("target_style_emb")
    share = [negated(v, q, seed + 50, id_col, *extra) for q in (0.02, 0.01)]
    moved = (
        F.when(kind.contains("_with_noise"), noisy(v, 0.01, seed + 40, id_col, *extra))
        .when(kind.contains("_with_negations") & kind.contains("author"), share[0])
        .when(kind.contains("_with_negations"), share[1])
        .otherwise(v)
    )
    return out.withColumn("target_style_emb", moved)


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float

    @staticmethod
    def mean_of(low: Column, high: Column) -> Column:
        return (low + high) / 2

    def mean(self) -> float:
        return (self.low + self.high) / 2

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return rng.uniform(self.low, self.high, n)


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float

    @staticmethod
    def mean_of(low: Column, high: Column) -> Column:
        return F.when(high > low, (high - low) / F.log(high / low)).otherwise(low)

    def mean(self) -> float:
        return (self.high - self.low) / math.log(self.high / self.low)

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return np.exp(rng.uniform(math.log(self.low), math.log(self.high), n))


@dataclass(frozen=True)
class Gamma:
    mean_len: float
    low: float
    high: float
    shape: float = 1.5

    def mean(self) -> float:
        return self.mean_len

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        return np.clip(rng.gamma(self.shape, self.mean_len / self.shape, n), self.low, self.high)


@dataclass(frozen=True)
class Mixture:
    parts: tuple
    weights: tuple[float, ...]

    @staticmethod
    def mean_of(means: Sequence[Column], weights: Sequence[float]) -> Column:
        whole = sum(weights)
        return sum((m * (w / whole) for m, w in zip(means, weights)), F.lit(0.0))

    def mean(self) -> float:
        whole = sum(self.weights)
        return sum(p.mean() * w for p, w in zip(self.parts, self.weights)) / whole

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        share = np.array(self.weights) / sum(self.weights)
        counts = rng.multinomial(n, share)
        out = np.concatenate([p.sample(rng, c) for p, c in zip(self.parts, counts)])
        rng.shuffle(out)
        return out


def numbered(df: DataFrame, by: Sequence[str], bucket: str, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` plus a number from 0 within ``by``, by ``bucket`` and then ``order``: the rows of earlier buckets plus a window within
    the bucket, so that no task orders a whole group."""
    sizes = df.groupBy(*by, bucket).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = W.partitionBy(*by, bucket).orderBy(*order)
    joined = df.join(sizes.select(*by, bucket, before.alias("_before")), [*by, bucket])
    return joined.withColumn(name, F.col("_before") + F.row_number().over(inner) - 1).drop("_before")


def ranked(df: DataFrame, u: Column, order: Sequence[Column], name: str, buckets: int = 4096) -> DataFrame:
    """``df`` plus its rank from 0 by a number ``u`` in [0, 1), then ``order``.

    Ranks are the rows of earlier buckets of ``u`` plus a window within the bucket, so no task sorts the whole table.
    """
    rows = df.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * buckets))
    return numbered(rows, [], "_bucket", ["_u", *order], name).drop("_u", "_bucket")


def epochs(df: DataFrame, n: int, seed: int, *key: str, max_samples: int | None = None) -> DataFrame:
    """``df`` once per epoch with columns epoch and position_key; order by both for the epoch's permutation.

    Every epoch has an order of its own, and with ``max_samples`` only the first so many of it. Seed 0 is a seed like any other.
    """
    out = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    out = out.withColumn("position_key", uniform(seed, F.col("epoch"), *key))
    if max_samples is None:
        return out
    # row_number keeps max_samples rows a task and epoch before the shuffle
    order = W.partitionBy("epoch").orderBy("position_key", *key)
    return out.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= max_samples).drop("_nth")


def interleaved(children: Sequence[DataFrame], weights: Sequence[float], draws: int, seed: int) -> DataFrame:
    """``draws`` rows of a weighted interleave: (draw, child, row of the child); an exhausted child starts over.

    The k-th draw of a child takes its row k modulo its size in the child's hash order. Children share a schema.
    """
    spark = children[0].sparkSession
    edges = np.cumsum(np.array(weights, dtype=float) / sum(weights))
    picks = spark.range(draws).withColumnRenamed("id", "draw")
    u = uniform(seed, F.col("draw"))
    child: Column = F.lit(len(children) - 1)
    for i in reversed(range(len(children) - 1)):
        child = F.when(u < float(edges[i]), i).otherwise(child)
    picks = picks.withColumn("child", child)
    out = None
    for i, df in enumerate(children):
        own = picks.filter(F.col("child") == i)
        size = df.count()
        if not size:
            continue
        placed = ranked(own, F.col("draw") / F.lit(float(max(draws, 1))), [F.col("draw")], "_rank")
        rows = df.select(F.struct(*df.columns).alias("row")).withColumn("_json", F.to_json("row"))
        ordered = ranked(rows, uniform(seed + 1 + i, F.col("_json")), [F.col("_json")], "_at").drop("_json")
        part = placed.withColumn("_at", F.pmod(F.col("_rank"), F.lit(size))).join(ordered, "_at").select("draw", "child", "row")
        out = part if out is None else out.unionByName(part)
    return out.select("draw", "child", "row.*")
