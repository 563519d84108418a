"""The registry of queries over the supplied tables, each with its SQL counterpart where SQL can express it.

Every query reads its whole tables. Numbers are rounded to six digits, as engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import scores as S
from tonewright.functions import text as X
from tonewright.functions import vector as V
from tonewright.functions.strings import chrf_score
from tonewright.operators import consistency as G
from tonewright.operators import reshape as R
from tonewright.operators import sampling as P
from tonewright.operators import segment as C
from tonewright.operators import select as A
from tonewright.session import spread, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
STYLE_SETS = {"SMALL": ["Brusnev", "Kudelin"], "LARGE": ["Brusnev", "Kudelin", "Verzhilin", "Chronicle"], "DOMAINS": ["news", "prose", "forum"]}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL counterpart where there is one."""

    def add(function):
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tonewright.plans import pairs, storage, training  # noqa: F401  they register their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def usable(v: str):
    """A vector of 64 finite values, not all zero."""
    values = V.as_double(v)
    return (F.size(values) == 64) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e300)) & F.exists(values, lambda x: x != 0)


def _usable_sql(v: str) -> str:
    return f"(len({v}) = 64 AND list_bool_and(list_transform({v}, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform({v}, lambda x: x <> 0)))"


def _cos_sql(u: str, v: str) -> str:
    d = lambda a, b: f"list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
    return f"({d(u, v)} / nullif(sqrt({d(u, u)}) * sqrt({d(v, v)}), 0))"


def _sim_sql(u: str, v: str) -> str:
    return f"((2.0 - acos(least(1.0, greatest(-1.0, {_cos_sql(u, v)}))) / pi()) / 2.0)"


_FINITE = "score IS NOT NULL AND NOT isnan(score)"
_BEST_SQL = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_number, target_style ORDER BY score DESC, version_number, row_id) AS k
                   FROM tst_results WHERE {_FINITE} AND example_number IS NOT NULL AND target_style IS NOT NULL) WHERE k = 1"""


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_version(table(spark, sf_dir, "tst_results"), position=("version_number", "row_id"))


@query("best_version", f"SELECT example_number, target_style, row_id, version_number, score FROM ({_BEST_SQL})")
def best_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("example_number", "target_style", "row_id", "version_number", "score")


def _sets_sql() -> str:
    rows = ", ".join(f"('{n}', '{s}')" for n, styles in STYLE_SETS.items() for s in styles)
    return f"(VALUES {rows}) AS sets(style_set, style)"


@query(
    "final_performance",
    f"""SELECT style_set, round(avg(score), 6) AS mean_score, count(score) AS n
        FROM {_sets_sql()} LEFT JOIN (SELECT * FROM ({_BEST_SQL}) WHERE NOT isinf(score)) b ON b.target_style = sets.style GROUP BY style_set""",
)
def final_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _best(spark, sf_dir).filter(~F.col("score").isin(float("inf"), float("-inf")))
    return rounded(A.final_performance(best, sets=STYLE_SETS), "mean_score")


_GEOMETRY = f"""
    SELECT row_id, example_number, target_style, version_number, s_cs, s_ct, s_st FROM (
      SELECT row_id, example_number, target_style, version_number,
             {_sim_sql("styled_text_style_emb", "text_style_emb")} AS s_cs, {_sim_sql("styled_text_style_emb", "centroid")} AS s_ct,
             {_sim_sql("text_style_emb", "centroid")} AS s_st
      FROM tst_results JOIN author_styles ON target_style = style
      WHERE {_usable_sql("text_style_emb")} AND {_usable_sql("styled_text_style_emb")})"""
_STYLE_SQL = f"""
    SELECT row_id, example_number, target_style, version_number, least(1 - s_cs, 1 - s_st) / nullif(1 - s_st, 0) AS away,
           greatest(s_ct - s_st, 0) / nullif(1 - s_st, 0) AS towards FROM ({_GEOMETRY})"""


def _geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["row_id", "example_number", "target_style", "version_number", "text_style_emb", "styled_text_style_emb"]
    rows = spread(table(spark, sf_dir, "tst_results").select(*columns)).filter(usable("text_style_emb") & usable("styled_text_style_emb"))
    known = A.with_centroids(rows, table(spark, sf_dir, "author_styles"), checked=False).filter("centroid is not null")
    # the three similarities once; away and towards are arithmetic on them
    sims = known.select(
        "row_id", "example_number", "target_style", "version_number", V.sim_measure("styled_text_style_emb", "text_style_emb").alias("cs"),
        V.sim_measure("styled_text_style_emb", "centroid").alias("ct"), V.sim_measure("text_style_emb", "centroid").alias("st"),
    )
    out = sims.withColumn("away", V.away_of(F.col("cs"), F.col("st"))).withColumn("towards", V.towards_of(F.col("ct"), F.col("st")))
    return out.withColumn("style", S.style_score("away", "towards"))


@query("style_geometry", f"SELECT row_id, round(away, 6) AS away, round(towards, 6) AS towards, round(sqrt(away * towards), 6) AS style FROM ({_STYLE_SQL})")
def style_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_geometry(spark, sf_dir).select("row_id", "away", "towards", "style"), "away", "towards", "style")


@query(
    "best_by_geometry",
    f"""SELECT target_style, count(*) AS n, round(avg(style), 6) AS mean_style FROM (
          SELECT *, row_number() OVER (PARTITION BY example_number, target_style ORDER BY style DESC, version_number, row_id) AS k
          FROM (SELECT *, round(sqrt(away * towards), 6) AS style FROM ({_STYLE_SQL})) WHERE style IS NOT NULL AND example_number IS NOT NULL)
        WHERE k = 1 GROUP BY target_style""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to similarities to style scores, the best version of each group, means per style."""
    scored = rounded(_geometry(spark, sf_dir), "style")
    best = A.best_version(scored, "style", position=("version_number", "row_id"))
    return rounded(best.groupBy("target_style").agg(F.count("*").alias("n"), F.avg("style").alias("mean_style")), "mean_style")


def _nan_safe(df: DataFrame, *columns: str) -> DataFrame:
    return df.filter(" and ".join(f"{c} is not null and not isnan({c})" for c in columns))


def _ce_sql() -> str:
    rows = [f"('{k}', {v})" for k, v in (S.DOMAIN_CE | S.AUTHOR_CE).items()]
    return f"(VALUES {', '.join(rows)}) AS known(style, ce)"


_COMPOSITE_COLUMNS = ["style_score", "bert_score", "labse_score", "text_perplexity", "styled_text_perplexity", "bi_score", "cl_score", "entity_score"]
_CLIP = "least(1.0, greatest(0.0, {}))"


@query(
    "composite_v2",
    f"""SELECT row_id, round(bi_cl, 6) AS bi_cl, round(meaning, 6) AS meaning_nolen, round(nat, 6) AS nat_v2,
               round(pow(style_score * sqrt(meaning) * sqrt(bi_cl) * (0.1 + 0.9 * g) * sqrt(0.1 + 0.9 * entity_score), 1.0 / 3.5) * nat, 6) AS score_v2
        FROM (SELECT row_id, style_score, entity_score, CASE WHEN gender_activated THEN coalesce(gender_score, 1.0) ELSE 1.0 END AS g,
                     1 - {_CLIP.format("greatest(bi_score, cl_score)")} AS bi_cl,
                     sqrt({_CLIP.format("(bert_score - 0.45) / 0.55")} * {_CLIP.format("(labse_score - 0.2) / 0.8")}) AS meaning,
                     1.0 / (greatest(styled_text_perplexity - greatest(coalesce(ce, text_perplexity), text_perplexity) - 0.7, 0) + 1) AS nat
              FROM tst_results LEFT JOIN {_ce_sql()} ON known.style = target_style
              WHERE {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _COMPOSITE_COLUMNS)})""",
)
def composite_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tonewright.plans.evaluate import version_two_scores

    rows = table(spark, sf_dir, "tst_results").select("row_id", "target_style", "gender_score", "gender_activated", *_COMPOSITE_COLUMNS)
    rows = _nan_safe(rows, *_COMPOSITE_COLUMNS).withColumn("gender_score", F.coalesce(F.when(F.col("gender_activated"), F.col("gender_score")), F.lit(1.0)))
    names = ["bi_cl", "meaning_nolen", "nat_v2", "score_v2"]
    return rounded(version_two_scores(rows).select("row_id", *names), *names)


_PAIR = "text IS NOT NULL AND styled_text IS NOT NULL"


@query(
    "pair_scores",
    f"""SELECT row_id, round(ratio, 6) AS length_ratio, round(0.5 - 0.5 * cos(pi() * ratio), 6) AS penalty,
               round(sqrt(1.0 / (8 * greatest(t - 4, 0) + 1) / (20 * greatest(t - greatest(s, 4), 0) + 1)), 6) AS naturality
        FROM (SELECT row_id, coalesce(least(length(text), length(styled_text)) / nullif(greatest(length(text), length(styled_text)), 0)::DOUBLE, 0.0) AS ratio,
                     text_perplexity AS s, styled_text_perplexity AS t
              FROM tst_results WHERE {_PAIR}) WHERE s IS NOT NULL AND t IS NOT NULL AND NOT isnan(s) AND NOT isnan(t)""",
)
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tst_results").filter(_PAIR)
    rows = _nan_safe(rows.select("row_id", "text", "styled_text", "text_perplexity", "styled_text_perplexity"), "text_perplexity", "styled_text_perplexity")
    ratio = S.length_ratio("text", "styled_text")
    natural = S.naturality_score("text_perplexity", "styled_text_perplexity")
    return rounded(rows.select("row_id", ratio.alias("length_ratio"), S.sin_penalty(ratio).alias("penalty"), natural.alias("naturality")), "length_ratio", "penalty", "naturality")


@query(
    "corpus_cross_entropy",
    """SELECT tst_model, round(sum(styled_text_perplexity * length(styled_text)) / sum(length(styled_text)), 6) AS corpus_ce FROM tst_results
       WHERE styled_text_perplexity IS NOT NULL AND NOT isnan(styled_text_perplexity) AND styled_text IS NOT NULL GROUP BY tst_model""",
)
def corpus_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tonewright.providers import corpus_cross_entropy as mean

    rows = _nan_safe(table(spark, sf_dir, "tst_results").select("tst_model", "styled_text", F.col("styled_text_perplexity").alias("ce")), "ce")
    rows = rows.filter("styled_text is not null").withColumn("n_tokens", F.length("styled_text"))
    return rounded(mean(rows, "ce", "n_tokens", "tst_model"), "corpus_ce")


_COMPLETE = [c for c, _, _ in A.KEEP if c not in ("tst_result_style_sim", "nat_v2")]
_NAT_SQL = "1.0 / (greatest(styled_text_perplexity - greatest(coalesce(ce, text_perplexity), text_perplexity) - 0.7, 0) + 1)"


@query(
    "keep_rate",
    f"""SELECT tst_model, count(*) AS tried, count(*) FILTER (WHERE chrf < 0.75 AND bi_score < 0.12 AND cl_score < 0.10 AND NOT (gender_activated AND gender_score < 0.70)
                 AND entity_score >= 0.70 AND meaning_score > 0.75 AND sim < 0.92 AND nat >= 0.75) AS succeeded,
               round(count(*) FILTER (WHERE chrf < 0.75 AND bi_score < 0.12 AND cl_score < 0.10 AND NOT (gender_activated AND gender_score < 0.70)
                 AND entity_score >= 0.70 AND meaning_score > 0.75 AND sim < 0.92 AND nat >= 0.75) / count(*)::DOUBLE, 6) AS rate
        FROM (SELECT *, {_sim_sql("text_style_emb", "styled_text_style_emb")} AS sim, {_NAT_SQL} AS nat FROM tst_results LEFT JOIN {_ce_sql()} ON known.style = target_style
              WHERE gender_activated IS NOT NULL AND (NOT gender_activated OR (gender_score IS NOT NULL AND NOT isnan(gender_score)))
                AND {_usable_sql("text_style_emb")} AND {_usable_sql("styled_text_style_emb")}
                AND {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in (*_COMPLETE, "text_perplexity", "styled_text_perplexity"))})
        GROUP BY tst_model""",
)
def keep_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of complete rows that the strict keep mask passes, by model."""
    rows = spread(table(spark, sf_dir, "tst_results")).filter(usable("text_style_emb") & usable("styled_text_style_emb"))
    rows = _nan_safe(rows, *_COMPLETE, "text_perplexity", "styled_text_perplexity")
    rows = rows.filter("gender_activated is not null and (not gender_activated or (gender_score is not null and not isnan(gender_score)))")
    rows = rows.withColumn("tst_result_style_sim", V.sim_measure("text_style_emb", "styled_text_style_emb"))
    rows = rows.withColumn("nat_v2", S.nat_v2("styled_text_perplexity", "text_perplexity", "target_style"))
    return rounded(A.pass_rate(rows, A.keep_mask(rows), "tst_model"), "rate")


@query(
    "other_styles",
    """SELECT style AS target_style, count(*) AS n, count(author) AS n_author FROM test_df CROSS JOIN (SELECT DISTINCT style FROM author_styles)
       WHERE author IS DISTINCT FROM style GROUP BY style""",
)
def other_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = R.other_styles(table(spark, sf_dir, "test_df").select("example_number", "author"), table(spark, sf_dir, "author_styles").select("style"))
    return pairs.groupBy("target_style").agg(F.count("*").alias("n"), F.count("author").alias("n_author"))


@query(
    "clean_words",
    r"""SELECT domain, word, count(*) AS n FROM (
          SELECT domain, CASE WHEN bare = '' THEN w ELSE bare END AS word FROM (
            SELECT domain, w, regexp_replace(w, '^[^\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+$', '', 'g') AS bare FROM (
              SELECT domain, unnest(string_split_regex(text, '[\s\x0b\x{85}\p{Z}]+')) AS w FROM test_df WHERE text IS NOT NULL) WHERE w <> ''))
        GROUP BY domain, word""",
)
def clean_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "test_df").select("domain", F.explode(X.clean_words("text")).alias("word"))
    return rows.groupBy("domain", "word").agg(F.count("*").alias("n"))


@query(
    "author_tags",
    """SELECT DISTINCT author, '<' || replace(lower(author), ' ', '_') || '>' AS tag, upper(substring(author, 1, 1)) || lower(substring(author, 2)) AS style
       FROM test_df WHERE author IS NOT NULL""",
)
def author_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "test_df").select("author").filter("author is not null").distinct()
    style = X.tag_style(F.concat(F.lit("<"), "author", F.lit(">")))
    return rows.select("author", X.author_tag("author").alias("tag"), style.alias("style"))


_WORDS_SQL = r"list_filter(string_split_regex({}, '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda w: w <> '')"


@query(
    "novel_spans",
    f"""WITH pairs AS (SELECT row_id, {_WORDS_SQL.format("styled_text")} AS t, {_WORDS_SQL.format("text")} AS s FROM tst_results
                       WHERE {_PAIR}),
        flags AS (SELECT row_id, n, unnest(range(n)) AS i, unnest(f) AS f FROM (
                    SELECT row_id, len(t) AS n, list_transform(t, lambda w: CASE WHEN list_contains(s, w) THEN 0 ELSE 1 END) AS f FROM pairs WHERE len(t) > 0)),
        dens AS (SELECT row_id, max(d) AS peak FROM (
                   SELECT a.row_id, a.i, avg(b.f) AS d FROM flags a JOIN flags b ON a.row_id = b.row_id
                     AND b.i BETWEEN a.i + (least(a.n, 9) - 1) // 2 - 8 AND a.i + (least(a.n, 9) - 1) // 2 GROUP BY a.row_id, a.i) GROUP BY row_id),
        runs AS (SELECT row_id, sum(CASE WHEN c >= 4 THEN c ELSE 0 END) AS hits FROM (
                   SELECT row_id, g, count(*) AS c FROM (SELECT row_id, i - row_number() OVER (PARTITION BY row_id ORDER BY i) AS g FROM flags WHERE f = 1)
                   GROUP BY row_id, g) GROUP BY row_id)
        SELECT p.row_id, len(p.t) AS n, round(coalesce(peak, 0), 6) AS bi_rolling, round(coalesce(hits, 0) / nullif(len(p.t), 0)::DOUBLE, 6) AS bi_span
        FROM pairs p LEFT JOIN dens USING (row_id) LEFT JOIN runs USING (row_id) WHERE len(p.t) > 0""",
)
def novel_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak density and share of long runs of answer words that the text lacks."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", "text", "styled_text")).filter(_PAIR).select("row_id", X.words("text").alias("s"), X.words("styled_text").alias("t"))
    rows = rows.filter(F.size("t") > 0).select("row_id", F.size("t").alias("n"), F.transform("t", lambda w: (~F.array_contains("s", w)).cast("int")).alias("f"))
    return rounded(rows.select("row_id", "n", X.peak_density("f").alias("bi_rolling"), X.span_score("f").alias("bi_span")), "bi_rolling", "bi_span")


@query(
    "chrf",
    f"""WITH pairs AS (SELECT DISTINCT text, styled_text, regexp_replace(styled_text, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', '', 'g') AS h,
                              regexp_replace(text, '[\\s\\x0b\\x{{85}}\\p{{Z}}]+', '', 'g') AS r FROM tst_results WHERE {_PAIR}),
        grams AS (SELECT text, styled_text, n, g, sum(a) AS a, sum(b) AS b FROM (
            SELECT text, styled_text, n, substring(h, k::BIGINT, n::BIGINT) AS g, 1 AS a, 0 AS b FROM (SELECT *, unnest(range(1, length(h) - n + 2)) AS k FROM pairs, range(1, 7) AS o(n))
            UNION ALL SELECT text, styled_text, n, substring(r, k::BIGINT, n::BIGINT), 0, 1 FROM (SELECT *, unnest(range(1, length(r) - n + 2)) AS k FROM pairs, range(1, 7) AS o(n)))
          GROUP BY ALL),
        orders AS (SELECT text, styled_text, n, sum(least(a, b)) AS shared, sum(a) AS a, sum(b) AS b FROM grams GROUP BY ALL),
        means AS (SELECT text, styled_text, avg(shared / a) AS p, avg(shared / b) AS r FROM orders WHERE a > 0 AND b > 0 GROUP BY ALL)
        SELECT tst_model, round(avg(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END), 6) AS chrf, count(*) AS n
        FROM tst_results t LEFT JOIN means m ON t.text = m.text AND t.styled_text = m.styled_text WHERE t.text IS NOT NULL AND t.styled_text IS NOT NULL GROUP BY tst_model""",
)
def chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean copying score by model; equal pairs are scored once."""
    rows = spread(table(spark, sf_dir, "tst_results").select("tst_model", "text", "styled_text")).filter(_PAIR)
    pairs = rows.groupBy("text", "styled_text", "tst_model").agg(F.count("*").alias("times"))
    scored = pairs.select("tst_model", "times", chrf_score("styled_text", "text").alias("chrf"))
    return rounded(scored.groupBy("tst_model").agg(S.weighted_mean("chrf", "times").alias("chrf"), F.sum("times").alias("n")), "chrf")


_SIMILARITY_SQL = f"""WITH units AS (SELECT domain, list_transform(CAST(text_style_emb AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(text_style_emb AS DOUBLE[]), CAST(text_style_emb AS DOUBLE[])))) AS u
                       FROM style_pool WHERE domain IS NOT NULL AND {_usable_sql("text_style_emb")}),
        dims AS (SELECT domain, d, avg(x) AS x FROM (SELECT domain, unnest(range(64)) AS d, unnest(u) AS x FROM units) GROUP BY domain, d),
        pairs AS (SELECT a.domain AS source, b.domain AS target, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c
                  FROM dims a JOIN dims b ON a.d = b.d AND a.domain <> b.domain GROUP BY a.domain, b.domain)
        SELECT source, target, round(c, 6) AS cosine FROM pairs"""


@query("domain_similarity", _SIMILARITY_SQL)
def domain_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "style_pool").filter("domain is not null").filter(usable("text_style_emb"))
    c = A.group_centroids(pool, "domain", "text_style_emb")  # one row per domain
    pairs = c.select(F.col("domain").alias("source"), F.col("centroid").alias("u")).crossJoin(c.select(F.col("domain").alias("target"), F.col("centroid").alias("v")))
    return rounded(pairs.filter("source <> target").select("source", "target", V.cosine("u", "v").alias("cosine")), "cosine")


@query(
    "norm_guard",
    f"""SELECT domain, count(*) FILTER (WHERE n BETWEEN 0.9 AND 1.1) AS normalized, count(*) FILTER (WHERE n > 10) AS unnormalized, count(*) AS n
        FROM (SELECT domain, sqrt(list_inner_product(CAST(text_style_emb AS DOUBLE[]), CAST(text_style_emb AS DOUBLE[]))) AS n FROM style_pool WHERE {_usable_sql("text_style_emb")})
        GROUP BY domain""",
)
def norm_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "style_pool").filter(usable("text_style_emb"))
    counted = [F.count_if(V.norm_ok("text_style_emb", kind)).alias(kind) for kind in ("normalized", "unnormalized")]
    return rows.groupBy("domain").agg(*counted, F.count("*").alias("n"))


@query(
    "rescaled_targets",
    f"""SELECT row_id, round(sqrt(list_inner_product(CAST(text_style_emb AS DOUBLE[]), CAST(text_style_emb AS DOUBLE[]))), 4) AS norm,
               round(list_extract(CAST(centroid AS DOUBLE[]), 1) / sqrt(list_inner_product(CAST(centroid AS DOUBLE[]), CAST(centroid AS DOUBLE[])))
                     * sqrt(list_inner_product(CAST(text_style_emb AS DOUBLE[]), CAST(text_style_emb AS DOUBLE[]))), 4) AS first
        FROM tst_results JOIN author_styles ON style = target_style WHERE {_usable_sql("text_style_emb")}""",
)
def rescaled_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tst_results").select("row_id", "target_style", "text_style_emb").filter(usable("text_style_emb"))
    known = A.with_centroids(rows, table(spark, sf_dir, "author_styles"), checked=False).filter("centroid is not null")
    out = known.withColumn("t", V.rescaled("centroid", "text_style_emb"))
    return rounded(out.select("row_id", V.norm("t").alias("norm"), F.element_at("t", 1).alias("first")), "norm", "first", digits=4)


@query("unknown_examples", "SELECT DISTINCT example_number FROM tst_results WHERE example_number NOT IN (SELECT example_number FROM test_df)")
def unknown_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unknown_ids(table(spark, sf_dir, "tst_results"), table(spark, sf_dir, "test_df"), "example_number")


@query("remaining_sources", "SELECT example_number, domain FROM test_df WHERE example_number NOT IN (SELECT example_number FROM tst_results WHERE example_number IS NOT NULL)")
def remaining_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.without(table(spark, sf_dir, "test_df"), table(spark, sf_dir, "tst_results"), "example_number").select("example_number", "domain")


@query(
    "both_directions",
    """SELECT row_id, 1 AS direction, length(text) AS n_source, length(styled_text) AS n_target FROM tst_results
       UNION ALL SELECT row_id, 0, length(styled_text), length(text) FROM tst_results""",
)
def both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tst_results")
    rows = rows.select(F.struct("row_id").alias("text_style_emb"), F.struct("row_id").alias("styled_text_style_emb"), "text", "styled_text")
    pairs = R.both_directions(rows)
    return pairs.select(F.col("style.row_id").alias("row_id"), "direction", F.length("source").alias("n_source"), F.length("target").alias("n_target"))


@query(
    "versions",
    """SELECT example_number, target_style, CAST(row_number() OVER (PARTITION BY example_number, target_style ORDER BY row_id) - 1 AS INTEGER) AS version_number, row_id
       FROM tst_results WHERE example_number IS NOT NULL AND target_style IS NOT NULL""",
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat answers to lists and back; the round trip numbers them in order."""
    rows = table(spark, sf_dir, "tst_results").filter("example_number is not null and target_style is not null").select("example_number", "target_style", "row_id")
    lists = R.regroup(rows.withColumn("o", F.col("row_id")), ["example_number", "target_style"], "o", "row_id")
    return R.expand_versions(lists, "versions", "row_id", ["example_number", "target_style"], ragged="allow")


@query(
    "chapter_chunks",
    r"""SELECT author, title, chapter_pos, count(*) AS n_sentences, CAST(sum(n) AS BIGINT) AS n_words,
               CAST(least(greatest(1, round_even(sum(n) / 40.0, 0)), count(*)) AS INTEGER) AS n_chunks
        FROM (SELECT author, title, chapter_pos, len(list_filter(string_split_regex(text_ru, '[\s\x0b\x{85}\p{Z}]+'), lambda w: w <> '')) AS n FROM book_chapters WHERE length(text_ru) > 0)
        GROUP BY author, title, chapter_pos""",
)
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "book_chapters").filter(F.length("text_ru") > 0).select("author", "title", "chapter_pos", F.size(X.words("text_ru")).alias("n"))
    groups = rows.groupBy("author", "title", "chapter_pos").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_words"))
    return groups.withColumn("n_chunks", C.chunk_count(F.col("n_words"), 40.0, F.col("n_sentences")))


@query(
    "source_options",
    """SELECT author, title, count(*) AS n, count(*) FILTER (WHERE a <> '' AND b <> '') AS both,
              CAST(sum(length(coalesce(nullif(a, ''), nullif(b, '')))) AS BIGINT) AS default_length
       FROM (SELECT author, title, text_source_opt1 AS a, text_source_opt2 AS b FROM book_chapters) GROUP BY author, title""",
)
def source_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["text_source_opt1", "text_source_opt2"]
    rows = table(spark, sf_dir, "book_chapters").select("author", "title", R.source_options(columns).alias("o"), R.default_option(columns).alias("d"))
    return rows.groupBy("author", "title").agg(
        F.count("*").alias("n"), F.count_if(F.size("o") == 2).alias("both"), F.sum(F.length("d.text")).alias("default_length")
    )


@query(
    "domain_weights",
    f"""SELECT source, target, round(w / sum(w) OVER (PARTITION BY source), 6) AS weight
        FROM (SELECT source, target, 1 - 0.95 * least(greatest((cosine - 0.82) / 0.15, 0), 1) AS w FROM ({_SIMILARITY_SQL}))""",
)
def domain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of the other domains as targets, from the measured similarities."""
    sims = domain_similarity(spark, sf_dir).withColumnRenamed("cosine", "sim")
    return rounded(S.domain_weights(sims), "weight")


@query(
    "pool_shares",
    """SELECT domain, author, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY domain)::DOUBLE, 6) AS share
       FROM style_pool WHERE domain IS NOT NULL AND author IS NOT NULL GROUP BY domain, author""",
)
def pool_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "style_pool").filter("domain is not null and author is not null").groupBy("domain", "author").agg(F.count("*").alias("n"))
    return rounded(A.shares(counts, "n", ["domain"]), "share")


@query(
    "decoded_prompts",
    """SELECT row_id, CASE WHEN style IS NULL THEN NULL ELSE regexp_replace(split_part(styled_text, '</s>', 1), '^[\\s\\x0b\\x{85}\\p{Z}]+|[\\s\\x0b\\x{85}\\p{Z}]+$', '', 'g') END AS decoded, style || ' ' || styled_text AS prompt
       FROM (SELECT row_id, styled_text, '<' || replace(lower(target_style), ' ', '_') || '>' AS style FROM tst_results)
       WHERE style IS NOT NULL AND styled_text IS NOT NULL""",
)
def decoded_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "tst_results").filter("target_style is not null and styled_text is not null").select("row_id", "styled_text", X.author_tag("target_style").alias("tag"))
    output = rows.withColumn("output", F.concat("tag", "styled_text"))
    return output.select("row_id", X.decoded("output", "tag", "</s>").alias("decoded"), X.prompt("tag", "styled_text").alias("prompt"))
