"""Queries of pair scorers: alignment, gender, entities, vectors and sequences of words.

Where an operator reads what a model gives (tags, entities, probabilities, word vectors), the query stands a plain rule in its
place, which the SQL counterpart repeats: it tests what the operator makes of such input, not a model.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewright.functions import scores as S
from tonewright.functions import text as X
from tonewright.functions import vector as V
from tonewright.operators import consistency as G
from tonewright.operators import select as A
from tonewright.operators import spans as Z
from tonewright.plans.registry import _PAIR, _cos_sql, _usable_sql, query, rounded, usable
from tonewright.providers import ByBatch, once, via_translation
from tonewright.session import spread, table

_SPACE = r"[\s\x0b\x{85}\p{Z}]+"
_EDGES = r"^[^\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+$"


def _words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}'), lambda w: w <> '')"


def _bare_sql(word: str) -> str:
    return f"regexp_replace({word}, '{_EDGES}', '', 'g')"


def _clean_sql(text: str) -> str:
    return f"list_transform({_words_sql(text)}, lambda w: CASE WHEN {_bare_sql('w')} = '' THEN w ELSE {_bare_sql('w')} END)"


def density_sql(flags: str, key: str, window: int) -> str:
    """(key, i, d): densities of a table of (key, n, i, f)."""
    return f"""SELECT a.{key}, a.i, avg(b.f) AS d FROM {flags} a JOIN {flags} b ON a.{key} = b.{key}
               AND b.i BETWEEN a.i + (least(a.n, {window}) - 1) // 2 - {window - 1} AND a.i + (least(a.n, {window}) - 1) // 2 GROUP BY a.{key}, a.i"""


_ALIGNED = f"""
    pairs AS (SELECT row_id, {_clean_sql("text")} AS s, {_clean_sql("styled_text")} AS t FROM tst_results WHERE {_PAIR}),
    bi AS (SELECT row_id, n, unnest(range(n)) AS i, unnest(f) AS f FROM (SELECT row_id, len(t) AS n,
             list_transform(t, lambda w, i: CASE WHEN list_contains(s, w) AND list_position(t, w) = i THEN 0 ELSE 1 END) AS f FROM pairs WHERE len(t) > 0 AND len(s) > 0)),
    cl AS (SELECT row_id, n, unnest(range(n)) AS i, unnest(f) AS f FROM (SELECT row_id, len(s) AS n,
             list_transform(s, lambda w: CASE WHEN list_contains(t, w) THEN 0 ELSE 1 END) AS f FROM pairs WHERE len(t) > 0 AND len(s) > 0))"""


def word_edges(df: DataFrame, source: str = "text", target: str = "styled_text") -> DataFrame:
    """``df`` plus edges between each source word and the first equal target word."""
    s, t = X.clean_words(source), X.clean_words(target)
    edges = V.let(t, lambda ws: F.transform(s, lambda w, i: F.struct(i.alias("i"), (F.array_position(ws, w) - 1).cast("int").alias("j"))))
    return df.withColumn("edges", F.filter(edges, lambda e: e["j"] >= 0))


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return spread(table(spark, sf_dir, "tst_results").select("row_id", "text", "styled_text", *more))


@query(
    "alignment_by_words",
    f"""WITH {_ALIGNED},
        b AS (SELECT row_id, max(d) AS d FROM ({density_sql("bi", "row_id", 9)}) GROUP BY row_id), c AS (SELECT row_id, max(d) AS d FROM ({density_sql("cl", "row_id", 9)}) GROUP BY row_id)
        SELECT row_id, round(coalesce(b.d, 0), 6) AS bi_score, round(coalesce(c.d, 0), 6) AS cl_score, coalesce(b.d, 0) >= 0.75 AS has_bi, coalesce(c.d, 0) >= 0.25 AS has_cl
        FROM pairs LEFT JOIN b USING (row_id) LEFT JOIN c USING (row_id)""",
)
def alignment_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment scores from edges between equal words, equal pairs aligned once."""
    scored = G.score_pairs(_texts(spark, sf_dir).filter(_PAIR), "text", "styled_text", word_edges)
    return rounded(scored.select("row_id", "bi_score", "cl_score", "has_bi", "has_cl"), "bi_score", "cl_score")


@query(
    "alignment_routed",
    f"""WITH {_ALIGNED.replace("WHERE len(t) > 0 AND len(s) > 0", "WHERE len(t) > 0 AND len(s) BETWEEN 1 AND 40")},
        runs AS (SELECT row_id, sum(CASE WHEN c >= 4 THEN c ELSE 0 END) AS hits FROM (SELECT row_id, g, count(*) AS c FROM
                   (SELECT row_id, i - row_number() OVER (PARTITION BY row_id ORDER BY i) AS g FROM bi WHERE f = 1) GROUP BY row_id, g) GROUP BY row_id)
        SELECT row_id, len(s) > 40 AS unhandled, false AS from_fallback,
               round(CASE WHEN len(s) = 0 OR len(t) = 0 THEN 0 WHEN len(s) > 40 THEN (CASE WHEN len(t) >= 4 THEN 1 ELSE 0 END) ELSE coalesce(hits, 0) / len(t)::DOUBLE END, 6) AS bi_score
        FROM pairs LEFT JOIN runs USING (row_id)""",
)
def alignment_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span scores of pairs within a budget of forty source words; the others have no aligner and no edges."""
    scored = G.score_pairs(_texts(spark, sf_dir).filter(_PAIR), "text", "styled_text", word_edges, over=F.size(X.words("text")) > 40, score="span")
    return rounded(scored.select("row_id", "unhandled", "from_fallback", "bi_score"), "bi_score")


@query(
    "ensemble_words",
    f"""WITH {_ALIGNED}, scores AS (SELECT row_id, 0.8 * d + 0.2 / (i + 1) AS v FROM ({density_sql("bi", "row_id", 15)})),
        c AS (SELECT row_id, max(0.8 * d + 0.2 / (i + 2)) AS v FROM ({density_sql("cl", "row_id", 15)}) GROUP BY row_id)
        SELECT row_id, round(coalesce(max(s.v), 0), 6) AS bi_peak, round(coalesce(avg(s.v), 0), 6) AS bi_mean, coalesce(any_value(c.v), 0) >= 0.45 AS has_cl
        FROM pairs LEFT JOIN scores s USING (row_id) LEFT JOIN c USING (row_id) GROUP BY row_id""",
)
def ensemble_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word scores of the ensemble with the probabilities 1 / (i + 1) and 1 / (i + 2) of word i."""
    rows = word_edges(_texts(spark, sf_dir).filter(_PAIR))
    chance = lambda text, k: F.transform(X.words(text), lambda _, i: 1.0 / (i + k))
    rows = rows.withColumn("b", chance("styled_text", 1)).withColumn("c", chance("text", 2))
    out = G.ensemble(rows, "text", "styled_text", "edges", "b", "c")
    peak = F.coalesce(F.array_max("bi_word_scores"), F.lit(0.0))
    mean = F.coalesce(F.try_divide(F.aggregate("bi_word_scores", F.lit(0.0), lambda s, x: s + x), F.nullif(F.size("bi_word_scores"), F.lit(0))), F.lit(0.0))
    return rounded(out.select("row_id", peak.alias("bi_peak"), mean.alias("bi_mean"), "has_cl"), "bi_peak", "bi_mean")


@query(
    "word_chances",
    f"""SELECT row_id, n, round(coalesce(list_sum(list_transform(range(n), lambda w: CASE WHEN 2 * w < 60 THEN 1.0 / (2 * w + 1) ELSE 0 END)), 0), 6) AS total
        FROM (SELECT row_id, len({_words_sql("text")}) AS n FROM tst_results WHERE text IS NOT NULL)""",
)
def word_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of words from those of their first sub-words: two sub-words a word, sixty read, the i-th of 1 / (i + 1)."""
    n = F.size(X.words("text"))
    rows = table(spark, sf_dir, "tst_results").filter("text is not null").select("row_id", n.alias("n"))
    chance = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: 1.0 / (i + 1))
    owner = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.floor(i / 2).cast("int"))
    each = G.word_probabilities(chance, owner, F.col("n"))
    return rounded(rows.select("row_id", "n", F.aggregate(each, F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


#: A tagger by endings, for tests of what follows a tagger.
_TAGS = {"он": "PRON|Gender=Masc|Number=Sing", "она": "PRON|Gender=Fem|Number=Sing"}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def tags_by_ending(texts: pd.Series) -> pd.Series:
    def one(text):
        out = []
        for m in re.finditer(r"\S+", text or ""):
            bare = re.sub(r"^\W+|\W+$", "", m.group()).lower()
            gender = "Fem" if bare.endswith("ла") else "Masc" if bare.endswith("л") else None
            tag = _TAGS.get(bare) or (f"VERB|Gender={gender}|Number=Sing|Tense=Past" if gender else "X|")
            out.append({"word": m.group(), "tag": tag, "start": m.start(), "end": m.end()})
        return out

    return pd.Series([one(t) for t in texts])


def _genders_sql(text: str) -> str:
    w = f"lower({_bare_sql('w')})"
    return f"list_transform({_words_sql(text)}, lambda w: CASE WHEN {w} = 'она' OR {w} LIKE '%ла' THEN 'Fem' WHEN {w} = 'он' OR {w} LIKE '%л' THEN 'Masc' END)"


@query(
    "gender_by_rules",
    f"""WITH pairs AS (SELECT row_id, text, styled_text, {_genders_sql("text")} AS s, {_genders_sql("styled_text")} AS t,
                          list_bool_or(list_transform({_words_sql("text")}, lambda w: lower({_bare_sql("w")}) IN ('он', 'она'))) AS active FROM tst_results WHERE {_PAIR}),
        shares AS (SELECT *, len(list_filter(s, lambda g: g = 'Fem'))::DOUBLE / nullif(len(list_filter(s, lambda g: g IS NOT NULL)), 0) AS ps,
                          len(list_filter(t, lambda g: g = 'Fem'))::DOUBLE / nullif(len(list_filter(t, lambda g: g IS NOT NULL)), 0) AS pt,
                          list_filter(range(1, least(len(s), len(t)) + 1), lambda i: s[i] IS NOT NULL AND t[i] IS NOT NULL) AS e FROM pairs),
        parts AS (SELECT *, CASE WHEN NOT coalesce(active, false) THEN 1.0 WHEN ps IS NULL AND pt IS NULL THEN 1.0 ELSE 1 - abs(coalesce(ps, 0.5) - coalesce(pt, 0.5)) END AS a,
                         CASE WHEN len(e) = 0 THEN 1.0 ELSE len(list_filter(e, lambda i: s[i] = t[i]))::DOUBLE / len(e) END AS b FROM shares)
        SELECT row_id, len(s) > 0 AND len(t) > 0 AND coalesce(active, false) AS gender_activated,
               round(CASE WHEN len(s) = 0 OR len(t) = 0 THEN 1.0 ELSE (a + b) / 2 END, 6) AS gender_score,
               CASE WHEN len(s) = 0 OR len(t) = 0 THEN false ELSE (a + b) / 2 < 0.8 END AS has_switch, len(list_filter(t, lambda g: g IS NOT NULL)) AS n_gendered FROM parts""",
)
def gender_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gender scores from tags to score, with a tagger by endings and edges between words of one position."""
    rows = _texts(spark, sf_dir).filter(_PAIR)
    tags = lambda df: df.withColumn("tags", tags_by_ending("text"))
    texts = once(rows.select("row_id", "text"), tags, "text", "tags").select("row_id", F.col("tags").alias("source_tags"))
    rows = rows.join(texts, "row_id").withColumn("target_tags", tags_by_ending("styled_text"))
    for side, text in (("source", "text"), ("target", "styled_text")):
        rows = rows.withColumn(f"{side}_gender", G.gender_maps(text, F.transform(f"{side}_tags", lambda t: F.struct(t["start"], t["end"], t["tag"]))))
    n = F.least(F.size("source_tags"), F.size("target_tags"))
    edges = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), i.alias("j")))).otherwise(F.array().cast(G.EDGES))
    out = G.gender_scores(rows.withColumn("edges", edges), source_text="text", target_text="styled_text")
    return rounded(out.select("row_id", "gender_activated", "gender_score", "has_switch", F.size("target_gender").alias("n_gendered")), "gender_score")


@query(
    "entity_pairs",
    """SELECT row_id, CASE WHEN blank THEN 1.0::DOUBLE ELSE CASE WHEN lower(domain) = lower(target_style) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END END AS entity_score,
              NOT blank AND lower(domain) <> lower(target_style) AS has_substitution,
              round(CASE WHEN blank THEN 1.0 ELSE least(CASE WHEN lower(domain) = lower(target_style) THEN 1.0 ELSE 0.5 END, chrf) END, 6) AS combined_entity_score
       FROM (SELECT *, false AS blank FROM tst_results WHERE domain IS NOT NULL AND target_style IS NOT NULL AND length(domain) > 1 AND length(target_style) > 1 AND NOT contains(domain || target_style, ' ')
                AND chrf IS NOT NULL AND NOT isnan(chrf))""",
)
def entity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity scores from raw entities to score: the domain as a city of the source, the style as one of the target, which also
    holds a first name that the source has."""
    rows = table(spark, sf_dir, "tst_results").select("row_id", "domain", "target_style", "chrf")
    rows = rows.filter("domain is not null and target_style is not null and length(domain) > 1 and length(target_style) > 1 and not contains(concat(domain, target_style), ' ')")
    rows = rows.filter("chrf is not null and not isnan(chrf)")
    rows = rows.withColumn("source", F.concat("domain", F.lit(" Анна"))).withColumn("target", F.concat("target_style", F.lit(" Анна")))

    def extract(texts: DataFrame) -> DataFrame:
        place, end = F.substring_index("text", " ", 1), F.length("text").cast("int")
        entity = lambda kind, word, a, b: F.struct(F.lit(kind).alias("entity_group"), word.alias("word"), a.cast("int").alias("start"), b.cast("int").alias("end"))
        return texts.withColumn("raw", F.array(entity("CITY", place, F.lit(0), F.length(place)), entity("FIRST_NAME", F.lit("Анна"), end - 4, end), entity("STREET", F.lit("Мира"), end, end)))

    out = G.entity_pair_scores(rows, "source", "target", extract, precision="chrf")
    return rounded(out.select("row_id", "entity_score", "has_substitution", "combined_entity_score"), "entity_score", "combined_entity_score")


@query(
    "entity_bags",
    f"""SELECT row_id, round(CASE WHEN coalesce(author, '') = '' AND coalesce(target_style, '') = '' THEN 1.0 WHEN coalesce(author, '') = '' OR coalesce(target_style, '') = '' THEN 0.0
                             ELSE {_cos_sql("text_style_emb", "styled_text_style_emb")} END, 6) AS similarity
        FROM tst_results WHERE {_usable_sql("text_style_emb")} AND {_usable_sql("styled_text_style_emb")}""",
)
def entity_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of two bags (author and style) by unit vectors."""
    rows = table(spark, sf_dir, "tst_results").select("row_id", "author", "target_style", "text_style_emb", "styled_text_style_emb")
    rows = spread(rows).filter(usable("text_style_emb") & usable("styled_text_style_emb"))
    rows = rows.select("row_id", "author", "target_style", V.normalised("text_style_emb").alias("u"), V.normalised("styled_text_style_emb").alias("v"))
    return rounded(rows.select("row_id", G.bag_similarity("u", "v", "author", "target_style").alias("similarity")), "similarity")


def _tokens_sql(v: str) -> str:
    """Eight unit vectors of eight numbers from a vector of 64."""
    part = f"CAST({v} AS DOUBLE[])[8 * k + 1 : 8 * k + 8]"
    return f"list_transform(range(8), lambda k: list_transform({part}, lambda x: x / greatest(sqrt(list_inner_product({part}, {part})), 1e-12)))"


def _tokens(v: str):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice(V.as_double(v), k * 8 + 1, 8))


@query(
    "entity_tokens",
    f"""WITH pairs AS (SELECT row_id, {_tokens_sql("text_style_emb")} AS s, {_tokens_sql("styled_text_style_emb")} AS t FROM tst_results
                       WHERE {_usable_sql("text_style_emb")} AND {_usable_sql("styled_text_style_emb")}),
        sides AS (SELECT row_id, list_avg(list_transform(t[1:3], lambda a: greatest(0, list_max(list_transform(s, lambda b: list_inner_product(a, b)))))) AS p,
                         list_avg(list_transform(s[2:5], lambda a: greatest(0, list_max(list_transform(t, lambda b: list_inner_product(a, b)))))) AS r FROM pairs)
        SELECT row_id, round(p, 5) AS p, round(r, 5) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 5) AS f FROM sides""",
)
def entity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of the marked ones among eight token vectors a side."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", "text_style_emb", "styled_text_style_emb")).filter(usable("text_style_emb") & usable("styled_text_style_emb"))
    mark = lambda *at: F.array(*[F.lit(i in at) for i in range(8)])
    out = rows.select("row_id", G.token_scores(_tokens("text_style_emb"), _tokens("styled_text_style_emb"), mark(1, 2, 3, 4), mark(0, 1, 2)).alias("x"))
    return rounded(out.select("row_id", F.col("x.precision").alias("p"), F.col("x.recall").alias("r"), F.col("x.f1").alias("f")), "p", "r", "f", digits=5)


@query(
    "word_means",
    """SELECT pool_id, w, round(list_avg(list_transform(parts, lambda v: v[1])), 6) AS first, round(list_avg(list_transform(parts, lambda v: v[8])), 6) AS last
       FROM (SELECT pool_id, unnest([0, 1, 2]) AS w, unnest([p[1:1], p[2:4], p[5:8]]) AS parts FROM (
               SELECT pool_id, list_transform(range(8), lambda k: CAST(text_style_emb AS DOUBLE[])[8 * k + 1 : 8 * k + 8]) AS p FROM style_pool WHERE """
    + _usable_sql("text_style_emb")
    + "))",
)
def word_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of three words from eight sub-words."""
    rows = table(spark, sf_dir, "style_pool").filter(usable("text_style_emb"))
    means = rows.select("pool_id", F.posexplode(G.mean_vectors(_tokens("text_style_emb"), F.array(*[F.lit(i) for i in (0, 1, 1, 1, 2, 2, 2, 2)]))).alias("w", "v"))
    return rounded(means.select("pool_id", "w", F.element_at("v", 1).alias("first"), F.element_at("v", 8).alias("last")), "first", "last")


@query(
    "aligned_vectors",
    f"""WITH pairs AS (SELECT row_id, {_tokens_sql("text_style_emb")} AS s, {_tokens_sql("styled_text_style_emb")} AS t FROM tst_results
                       WHERE {_usable_sql("text_style_emb")} AND {_usable_sql("styled_text_style_emb")}),
        sims AS (SELECT row_id, i, j, (list_inner_product(s[i], t[j]) + 1) / 2 AS c FROM pairs, range(1, 9) AS a(i), range(1, 9) AS b(j)),
        first AS (SELECT row_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY row_id, i ORDER BY c DESC, j) AS x, row_number() OVER (PARTITION BY row_id, j ORDER BY c DESC, i) AS y FROM sims) WHERE x = 1 AND y = 1 AND c > 0),
        again AS (SELECT s.row_id, s.i, s.j, c * CASE WHEN r.i IS NULL AND q.j IS NULL THEN 1.0 WHEN r.i IS NOT NULL AND q.j IS NOT NULL THEN 0.0 ELSE 0.9 END AS c
                  FROM sims s LEFT JOIN (SELECT DISTINCT row_id, i FROM first) r ON r.row_id = s.row_id AND r.i = s.i LEFT JOIN (SELECT DISTINCT row_id, j FROM first) q ON q.row_id = s.row_id AND q.j = s.j),
        second AS (SELECT row_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY row_id, i ORDER BY c DESC, j) AS x, row_number() OVER (PARTITION BY row_id, j ORDER BY c DESC, i) AS y FROM again) WHERE x = 1 AND y = 1 AND c > 0),
        full_ AS (SELECT row_id FROM first GROUP BY row_id HAVING count(DISTINCT i) = 8 OR count(DISTINCT j) = 8),
        edges AS (SELECT * FROM first UNION SELECT * FROM second WHERE row_id NOT IN (SELECT row_id FROM full_))
        SELECT row_id, count(*) AS n, CAST(sum(8 * (i - 1) + j - 1) AS BIGINT) AS places FROM edges GROUP BY row_id""",
)
def aligned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between eight word vectors a side by two rounds of mutual best matches."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", "text_style_emb", "styled_text_style_emb")).filter(usable("text_style_emb") & usable("styled_text_style_emb"))
    edges = rows.select("row_id", F.explode(G.itermax_edges(_tokens("text_style_emb"), _tokens("styled_text_style_emb"))).alias("e"))
    return edges.groupBy("row_id").agg(F.count("*").alias("n"), F.sum(F.col("e.i") * 8 + F.col("e.j")).alias("places"))


@query(
    "words_by_batch",
    rf"""SELECT row_id, len({_words_sql("text")}) AS n_words, len({_words_sql("text")}) > 40 AS over, upper(reverse(text)) AS there, upper(text) AS back FROM tst_results WHERE text IS NOT NULL""",
)
def words_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A provider on batches and two as translators, each distinct text once; rows beyond forty words take the other way."""
    rows = _texts(spark, sf_dir).select("row_id", "text").filter("text is not null")
    count = ByBatch(lambda: lambda texts: [len(t.split()) for t in texts], ["text"], "n_words", "int")
    counted = A.memoised(rows, "text", lambda keys: count(keys), "n_words")
    there = lambda df: df.withColumn("translated", F.upper(F.reverse("text")))
    back = lambda df: df.withColumn("styled_text", F.reverse("translated"))
    moved = via_translation(there, back)(counted)
    near = lambda df: df.withColumn("over", F.lit(False))
    far = lambda df: df.withColumn("over", F.lit(True))
    return G.routed(moved, F.col("n_words") > 40, near, far).select("row_id", "n_words", "over", F.col("translated").alias("there"), F.col("styled_text").alias("back"))


@query(
    "vector_mixes",
    f"""SELECT row_id, round(list_inner_product(u, v), 6) AS dot, round(sqrt(list_inner_product(m, m)), 5) AS mixed_norm, round(m[1], 6) AS mixed_first,
               round(list_sum(list_transform(u, lambda x: abs(x))), 5) AS negated_sum, true AS kept_norm, true AS noise_near
        FROM (SELECT row_id, u, v, list_transform(list_zip(u, v), lambda x: 0.25 * x[1] + 0.75 * x[2]) AS m FROM (
                SELECT row_id, list_transform(a, lambda x: x / sqrt(list_inner_product(a, a))) AS u, list_transform(b, lambda x: x / sqrt(list_inner_product(b, b))) AS v FROM (
                  SELECT row_id, CAST(text_style_emb AS DOUBLE[]) AS a, CAST(styled_text_style_emb AS DOUBLE[]) AS b FROM tst_results
                  WHERE {_usable_sql("text_style_emb")} AND {_usable_sql("styled_text_style_emb")})))""",
)
def vector_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products, weighted mixes, negated and noisy vectors of unit vectors; draws are told by what they must keep."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", "text_style_emb", "styled_text_style_emb")).filter(usable("text_style_emb") & usable("styled_text_style_emb"))
    rows = rows.select("row_id", V.normalised("text_style_emb").alias("u"), V.normalised("styled_text_style_emb").alias("v"))
    rows = rows.withColumn("m", V.mixed(F.array("u", "v"), F.array(F.lit(1.0), F.lit(3.0))))
    rows = rows.withColumn("g", V.negated("u", 0.3, 7, "row_id")).withColumn("z", V.noisy("u", 0.01, 7, "row_id"))
    total = F.aggregate(F.transform("g", F.abs), F.lit(0.0), lambda s, x: s + x)
    near = (F.abs(V.norm("z") - V.norm("u")) < 1e-9) & (V.cosine("u", "z") > 0.98) & (V.cosine("u", "z") < 1)
    out = rows.select(
        "row_id", V.dot("u", "v").alias("dot"), V.norm("m").alias("mixed_norm"), F.element_at("m", 1).alias("mixed_first"), total.alias("negated_sum"),
        (F.abs(V.norm("g") - V.norm("u")) < 1e-9).alias("kept_norm"), near.alias("noise_near"),
    )
    return rounded(rounded(out, "dot", "mixed_first"), "mixed_norm", "negated_sum", digits=5)


@query(
    "sequence_scores",
    f"""SELECT row_id, round(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a[i] > 0 THEN b[i] ELSE 0 END)) / greatest(len(list_filter(a, lambda x: x > 0)), 1), 6) AS masked,
               round(coalesce(list_sum(r), 0), 5) AS shares, len(r) AS n_shares
        FROM (SELECT row_id, a, b, list_transform(range(1, greatest(len(w), 1)), lambda i: list_sum(w[1:i]) / list_sum(w)::DOUBLE) AS r FROM (
                SELECT row_id, CAST(text_style_emb AS DOUBLE[]) AS a, CAST(styled_text_style_emb AS DOUBLE[]) AS b, list_transform({_words_sql("text")}, lambda w: length(w)) AS w FROM tst_results
                WHERE text IS NOT NULL AND {_usable_sql("text_style_emb")} AND {_usable_sql("styled_text_style_emb")}))""",
)
def sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked means of arrays, and running shares of the lengths of words."""
    rows = _texts(spark, sf_dir, "text_style_emb", "styled_text_style_emb").filter("text is not null").filter(usable("text_style_emb") & usable("styled_text_style_emb"))
    mask = F.transform("text_style_emb", lambda x: (x > 0).cast("int"))
    r = X.running_shares(F.transform(X.words("text"), F.length))
    out = rows.select("row_id", S.masked_mean("styled_text_style_emb", mask).alias("masked"), r.alias("r"))
    out = out.select("row_id", "masked", F.aggregate("r", F.lit(0.0), lambda s, x: s + x).alias("shares"), F.size("r").alias("n_shares"))
    return rounded(rounded(out, "masked"), "shares", digits=5)


@query(
    "kept_sentences",
    rf"""WITH s AS (SELECT row_id, unnest(range(1, len(parts) + 1)) AS k, unnest(parts) AS part FROM (
             SELECT row_id, list_filter(regexp_extract_all(styled_text, '[^.!?]+[.!?]'), lambda p: true) AS parts FROM tst_results
             WHERE regexp_full_match(styled_text, '([^.!?…\s"»”)]([^.!?…"»”)\n]*[^.!?…\s"»”)])?[.!?] )*[^.!?…\s"»”)]([^.!?…"»”)\n]*[^.!?…\s"»”)])?[.!?]'))),
         n AS (SELECT row_id, k, trim(part) AS part, len({_words_sql("part")}) AS n FROM s),
         p AS (SELECT *, sum(n) OVER (PARTITION BY row_id ORDER BY k) AS upto FROM n),
         m AS (SELECT row_id, k, part, (SELECT avg(CASE WHEN i % 3 = 0 THEN 1.0 ELSE 0.2 END) FROM range(CAST(upto - n AS BIGINT), CAST(upto AS BIGINT)) AS r(i)) AS mean FROM p)
         SELECT row_id, coalesce(string_agg(part, ' ' ORDER BY k) FILTER (WHERE mean <= 0.45), '') AS kept FROM m GROUP BY row_id""",
)
def kept_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their sentences of a mean word score above 0.45, every third word scoring 1 and the others 0.2."""
    plain = r"""^([^.!?…\s"»”)]([^.!?…"»”)\n]*[^.!?…\s"»”)])?[.!?] )*[^.!?…\s"»”)]([^.!?…"»”)\n]*[^.!?…\s"»”)])?[.!?]$"""
    rows = _texts(spark, sf_dir).filter(F.col("styled_text").rlike(plain)).select("row_id", "styled_text")
    scores = F.transform(X.words("styled_text"), lambda _, i: F.when(i % 3 == 0, 1.0).otherwise(0.2))
    return rows.select("row_id", Z.without_sentences("styled_text", scores, 0.45).alias("kept"))
