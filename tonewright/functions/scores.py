"""Scalar scores as column expressions (survey M1-M14, A3, A4, A7, A11, G11, G14, G17)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Median cross-entropies of authors.
AUTHOR_CE = {
    "Chekhov": 3.641447, "Zoschenko": 3.813564, "News": 3.147179, "Dovlatov": 3.758374, "Putin": 3.414283,
    "Ilf and Petrov": 3.715437, "Medvedev": 3.643130, "Pushkin": 3.867682, "Lermontov": 3.768750, "Zhvaneckiy": 3.911052,
    "Bulgakov": 3.771773, "Dostoevsky": 3.835618, "Bryusov": 3.702599, "Yerofeyev": 3.755454, "Gorky": 3.853821,
    "Turgenev": 3.777817, "Blok": 3.897557, "Bible": 3.666696, "Tolstoy": 3.743540, "Gogol": 3.965799, "Herzen": 4.047286,
    "Nabokov": 3.930439,
}
#: Median cross-entropies of domains, used where no author is known.
DOMAIN_CE = {
    "news": 3.151731, "wikipedia": 3.421043, "ficbook": 3.807949, "pikabu": 4.046271, "taiga_proza": 3.876610,
    "taiga_magazines": 3.876763, "writers": 3.962501, "Bible": 3.857263, "political": 3.649666,
}
#: Domains, and the cosine of the centroids of each two.
DOMAINS = ["news", "wikipedia", "ficbook", "pikabu", "taiga_proza", "taiga_magazines", "writers", "Bible", "political"]
DOMAIN_SIM = [
    ("news", "wikipedia", 0.9652), ("news", "ficbook", 0.5094), ("news", "pikabu", 0.6555),
    ("news", "taiga_proza", 0.5734), ("news", "taiga_magazines", 0.6505), ("news", "writers", 0.5271),
    ("news", "Bible", 0.4305), ("news", "political", 0.5698), ("wikipedia", "ficbook", 0.6739),
    ("wikipedia", "pikabu", 0.7914), ("wikipedia", "taiga_proza", 0.7523), ("wikipedia", "taiga_magazines", 0.8169),
    ("wikipedia", "writers", 0.6901), ("wikipedia", "Bible", 0.5123), ("wikipedia", "political", 0.6615),
    ("ficbook", "pikabu", 0.9428), ("ficbook", "taiga_proza", 0.9414), ("ficbook", "taiga_magazines", 0.8627),
    ("ficbook", "writers", 0.7443), ("ficbook", "Bible", 0.5099), ("ficbook", "political", 0.6232),
    ("pikabu", "taiga_proza", 0.9381), ("pikabu", "taiga_magazines", 0.8902), ("pikabu", "writers", 0.7765),
    ("pikabu", "Bible", 0.5345), ("pikabu", "political", 0.7171), ("taiga_proza", "taiga_magazines", 0.9606),
    ("taiga_proza", "writers", 0.8521), ("taiga_proza", "Bible", 0.5651), ("taiga_proza", "political", 0.698),
    ("taiga_magazines", "writers", 0.8701), ("taiga_magazines", "Bible", 0.5447), ("taiga_magazines", "political", 0.6728),
    ("writers", "Bible", 0.5859), ("writers", "political", 0.6245), ("Bible", "political", 0.5059),
]
#: Domains without author targets.
DOMAIN_ONLY = ["news", "wikipedia", "taiga_magazines", "Bible", "political", "ficbook", "taiga_proza", "pikabu"]
NAT_MARGIN = 0.70
FLOOR = 0.10


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clip(x, low: float, high: float) -> Column:
    """x within [low, high]; null and NaN stay what they are."""
    x = _c(x)
    return F.when(F.isnan(x), x).when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def min_max_labse(x) -> Column:
    return clip((_c(x) - 0.2) / 0.8, 0.0, 1.0)


def min_max_bert(x) -> Column:
    return clip((_c(x) - 0.45) / 0.55, 0.0, 1.0)


def length_ratio(a, b) -> Column:
    """The shorter over the longer length in code points; 0 when both are empty."""
    m, n = F.length(_c(a)), F.length(_c(b))
    return F.when(m.isNotNull() & n.isNotNull(), F.coalesce(F.try_divide(F.least(m, n), F.greatest(m, n)), F.lit(0.0)))


def sin_penalty(x) -> Column:
    return 0.5 - 0.5 * F.cos(F.lit(math.pi) * _c(x))


def length_penalty(a, b) -> Column:
    return sin_penalty(length_ratio(a, b))


def meaning_score(bert, labse, penalty=1.0) -> Column:
    return _c(penalty) * F.sqrt(min_max_bert(bert) * min_max_labse(labse))


def naturality_score(source_ce, target_ce) -> Column:
    """The older naturality: penalties for a high cross-entropy and for one above the source's."""
    s, t = _c(source_ce), _c(target_ce)
    above = F.greatest(t - 4.0, F.lit(0.0))
    over = F.greatest(t - F.greatest(s, F.lit(4.0)), F.lit(0.0))
    value = F.sqrt(1.0 / (8.0 * above + 1.0) / (20.0 * over + 1.0))
    return F.when(s.isNotNull() & t.isNotNull(), value)


def style_score(away, towards) -> Column:
    return F.sqrt(_c(away) * _c(towards))


def combined_score(style, meaning, naturality) -> Column:
    return F.pow(_c(style) * _c(meaning) * _c(naturality), F.lit(1.0 / 3.0))


def target_ce(style) -> Column:
    """Median cross-entropy of a style: of the author, else of the domain, else null."""
    def table(values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    s = _c(style)
    return F.coalesce(F.try_element_at(table(AUTHOR_CE), s), F.try_element_at(table(DOMAIN_CE), s))


def nat_v2(styled_ce, source_ce, style=None, margin: float = NAT_MARGIN) -> Column:
    """1 within ``margin`` of the reference cross-entropy, falling beyond; the source is the reference's floor."""
    sty, src = _c(styled_ce), _c(source_ce)
    known = target_ce(style) if style is not None else F.lit(None).cast("double")
    reference = F.when(known.isNotNull(), F.greatest(known, src)).otherwise(src)
    value = 1.0 / (F.greatest(sty - reference - margin, F.lit(0.0)) + 1.0)
    return F.when(sty.isNotNull() & src.isNotNull(), value)


def bi_cl(bi, cl) -> Column:
    """1 - clip(max(bi, cl)); null when either is null, NaN when either is NaN."""
    b, c = _c(bi), _c(cl)
    return F.when(b.isNotNull() & c.isNotNull(), 1.0 - clip(F.greatest(b, c), 0.0, 1.0))


def base_score_v2(style, meaning, bicl, gender, entity, floor: float = FLOOR) -> Column:
    """Geometric mean of style and the weighted factors of meaning; gender and entities are lifted to ``floor``."""
    g, e = (floor + (1.0 - floor) * _c(x) for x in (gender, entity))
    # (mv ** 2.5) with mv the 2.5th root of the product is the product itself
    factors = F.sqrt(_c(meaning)) * F.sqrt(_c(bicl)) * g * F.sqrt(e)
    return F.pow(_c(style) * factors, F.lit(1.0 / 3.5))


def combined_entity(entity, precision) -> Column:
    e, p = _c(entity), _c(precision)
    return F.when(e.isNotNull() & p.isNotNull(), F.least(e, p))


def domain_similarity(spark: SparkSession) -> DataFrame:
    """(source, target, sim): the similarities of all two different domains, both ways."""
    return spark.createDataFrame(DOMAIN_SIM + [(b, a, v) for a, b, v in DOMAIN_SIM], "source string, target string, sim double")


def domain_weights(sims: DataFrame, floor: float = 0.05, near: float = 0.82, same: float = 0.97) -> DataFrame:
    """(source, target, weight): how often each other domain is a target of ``source``.

    All weigh alike up to a similarity of ``near``; from there the weight falls in a straight line, to ``floor`` at ``same``.
    The weights of a source add up to 1. A source that ``sims`` lacks has no rows.
    """
    steps = sims.filter("source <> target").select("source", "target", clip((F.col("sim") - near) / (same - near), 0.0, 1.0).alias("excess"))
    raw = steps.withColumn("weight", F.lit(1.0) - F.lit(1.0 - floor) * F.col("excess"))
    sums = raw.groupBy("source").agg(F.sum("weight").alias("_sum"))
    return raw.join(sums, "source").select("source", "target", (F.col("weight") / F.col("_sum")).alias("weight"))


def target_styles(domain: str, has_author_targets: bool | None = None) -> list[str]:
    """The kinds of target a source domain may get, each plain, negated and noisy."""
    if has_author_targets is None:
        has_author_targets = domain not in DOMAIN_ONLY
    kinds = (["other_author", "2_authors_weighted_avg"] if has_author_targets else []) + ["other_domain", "2_domains_weighted_avg"]
    return [kind + suffix for kind in kinds for suffix in ("", "_with_negations", "_with_noise")]


def p_fem(genders) -> Column:
    """Share of Fem among Masc and Fem in an array; null when there is neither."""
    g = _c(genders)
    fem, masc = F.size(F.filter(g, lambda x: x == "Fem")), F.size(F.filter(g, lambda x: x == "Masc"))
    return F.when(g.isNotNull(), F.try_divide(fem, fem + masc))


def distribution_score(source, target) -> Column:
    """1 - |difference of the shares of Fem|; a side without gender counts one half, two such sides give 1."""
    s, t = p_fem(source), p_fem(target)
    return F.when(s.isNull() & t.isNull(), 1.0).otherwise(1.0 - F.abs(F.coalesce(s, F.lit(0.5)) - F.coalesce(t, F.lit(0.5))))


def weighted_mean(value, weight) -> Column:
    """Aggregate: sum(value * weight) / sum(weight)."""
    return F.try_divide(F.sum(_c(value) * _c(weight)), F.sum(F.when(_c(value).isNotNull(), _c(weight))))


def masked_mean(losses, mask) -> Column:
    """Mean of an array of losses where the mask is 1; the divisor is at least 1."""
    total = F.aggregate(F.zip_with(_c(losses).cast("array<double>"), _c(mask).cast("array<double>"), lambda a, m: a * m), F.lit(0.0), lambda s, x: s + x)
    count = F.aggregate(_c(mask).cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return total / F.greatest(count, F.lit(1.0))
