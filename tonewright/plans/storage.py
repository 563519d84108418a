"""Queries of sources, sinks, selection and the evaluation plan."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import scores as S
from tonewright.functions import text as X
from tonewright.functions import vector as V
from tonewright.operators import reshape as R
from tonewright.operators import select as A
from tonewright.plans.evaluate import Evaluation, version_one_scores
from tonewright.plans.registry import _STYLE_SQL, STYLE_SETS, _nan_safe, _sets_sql, _sim_sql, _usable_sql, query, rounded, usable
from tonewright.session import checkpoint_dir, spread, table
from tonewright.sources import readers, sink


def _folder(spark: SparkSession) -> str:
    """A fresh place in the shared folder."""
    return f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"


@query(
    "loaded_sources",
    "SELECT domain, count(*) AS n, count(DISTINCT example_number) AS n_ids, CAST(sum(length(text)) AS BIGINT) AS chars FROM test_df GROUP BY domain",
)
def loaded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_sources(spark, f"{sf_dir}/test_df.parquet")
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.countDistinct("example_number").alias("n_ids"), F.sum(F.length("text")).alias("chars"))


@query(
    "centroid_archive",
    """SELECT style, round(sqrt(list_inner_product(CAST(centroid AS DOUBLE[]), CAST(centroid AS DOUBLE[]))), 4) AS norm, 1.0::DOUBLE AS unit_norm,
              round(CAST(centroid AS DOUBLE[])[1] / sqrt(list_inner_product(CAST(centroid AS DOUBLE[]), CAST(centroid AS DOUBLE[]))), 6) AS first FROM author_styles""",
)
def centroid_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroids (one row a style) through an archive, as stored and scaled to norm 1; the archive's metadata is left out."""
    held = {r["style"]: np.array(r["centroid"], dtype=np.float32) for r in table(spark, sf_dir, "author_styles").collect()}
    frames = []
    for scale in (False, True):
        archive = io.BytesIO()
        np.savez(archive, dim=np.array([64]), **held)
        archive.seek(0)
        frames.append(readers.read_centroids(spark, archive, scale))
    raw, unit = frames
    both = raw.join(unit.withColumnRenamed("centroid", "unit"), "style")
    out = both.select("style", V.norm("centroid").alias("norm"), V.norm("unit").alias("unit_norm"), F.element_at("unit", 1).alias("first"))
    return rounded(rounded(out, "norm", digits=4), "unit_norm", "first")


@query(
    "scored_answers",
    """SELECT domain, count(*) AS n, round(avg(score), 6) AS mean, CAST(sum(length(styled_text)) AS BIGINT) AS chars FROM tst_results
       WHERE tst_model = 'gst-small' AND score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score) AND length(styled_text) > 0 GROUP BY domain""",
)
def scored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored answers written as compressed CSV and read again, those of one model."""
    rows = table(spark, sf_dir, "tst_results").select(F.col("tst_model").alias("llm"), "domain", "styled_text", "score")
    rows = rows.filter("score is not null and not isnan(score) and abs(score) <> double('infinity') and length(styled_text) > 0")
    path = _folder(spark)
    whole = {"header": True, "escape": '"', "quoteAll": True, "compression": "gzip", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**whole).csv(path)
    got = readers.read_scored_answers(spark, path, "llm string, domain string, styled_text string, score double", "gst-small")
    got = got.groupBy(F.nullif("domain", F.lit("")).alias("domain")).agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.sum(F.length("styled_text")).alias("chars"))
    return rounded(got, "mean")


@query(
    "news_pairs",
    """SELECT 'News' AS author, count(*) AS n, CAST(sum(length(text_ru)) AS BIGINT) AS chars, CAST(sum(length(text_source_opt1)) AS BIGINT) AS source_chars FROM book_chapters
       WHERE length(text_ru) > 0 AND length(text_source_opt1) > 0""",
)
def news_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs from two compressed CSV files, one behind the other."""
    rows = table(spark, sf_dir, "book_chapters").filter("length(text_ru) > 0 and length(text_source_opt1) > 0")
    rows = rows.select("text_ru", F.col("text_source_opt1").alias("text_ru_pph"), (F.col("sent_pos") % 2).alias("file"))
    paths = [_folder(spark) for _ in range(2)]
    whole = {"header": True, "escape": '"', "quoteAll": True, "compression": "gzip", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for k, path in enumerate(paths):
        rows.filter(F.col("file") == k).drop("file").write.options(**whole).csv(path)
    news = readers.read_news(spark, paths)
    return news.groupBy("author").agg(F.count("*").alias("n"), F.sum(F.length("text_ru")).alias("chars"), F.sum(F.length("text_ru_pph")).alias("source_chars"))


@query(
    "training_cycle",
    """SELECT 0 AS file_no, e AS epoch, count(*) AS n, count(*) AS n_places, count(DISTINCT example_number) AS n_rows FROM test_df, range(2) AS r(e) GROUP BY e
       UNION ALL SELECT 1, e, count(*), count(*), count(DISTINCT pool_id) FROM style_pool, range(2) AS r(e) GROUP BY e""",
)
def training_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files, each processed once, in two epochs of different order: every row has a place of its own in each."""
    rows = readers.read_training(
        spark, [f"{sf_dir}/test_df.parquet", f"{sf_dir}/style_pool.parquet"], lambda df: df.select(F.col(next(c for c in ("example_number", "pool_id") if c in df.columns)).alias("id"), "domain"),
        seed=3, n_epochs=2, key=["id"],
    )
    counts = rows.groupBy("file_no", "epoch").agg(F.count("*").alias("n"), F.countDistinct("position_key").alias("n_places"), F.countDistinct("id").alias("n_rows"))
    return counts.withColumn("epoch", F.col("epoch").cast("long"))


_STORED = "meaning_score IS NOT NULL AND example_number IS NOT NULL"


@query(
    "stored_results",
    f"""SELECT count(*) AS n, count(DISTINCT example_number) AS n_examples, CAST(sum(length(styled_text)) AS BIGINT) AS chars, true AS in_order, 1 AS parts,
               (SELECT count(*) FROM test_df WHERE example_number NOT IN (SELECT example_number FROM tst_results WHERE {_STORED})) AS left_over FROM tst_results WHERE {_STORED}""",
)
def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results stored in three parts, joined to one in order of their ids, and the sources that no part holds."""
    rows = table(spark, sf_dir, "tst_results").filter(_STORED).withColumn("tst_result_style_sim", F.col("style_score")).withColumn("nat_v2", F.col("naturality_score"))
    folder = _folder(spark)
    for k in range(3):
        sink.save_results(rows.filter(F.col("row_id") % 3 == k), folder)
    whole = sink.compact(spark, folder)
    files = whole.groupBy(F.input_file_name().alias("file"), F.spark_partition_id().alias("p")).agg(F.collect_list("example_number").alias("ids"))
    in_order = files.agg(F.every(F.col("ids") == F.sort_array("ids")).alias("in_order"))  # a file is bounded by FILE_BYTES
    left = sink.remaining(table(spark, sf_dir, "test_df"), spark, folder).agg(F.count("*").alias("left_over"))
    sums = whole.agg(F.count("*").alias("n"), F.countDistinct("example_number").alias("n_examples"), F.sum(F.length("styled_text")).alias("chars"))
    one = sums.crossJoin(F.broadcast(in_order)).crossJoin(F.broadcast(left))  # one row each
    return one.withColumn("parts", F.lit(len(sink.parts(spark, folder))))


_V1_COLUMNS = ("bert_score", "labse_score", "text_perplexity", "styled_text_perplexity")
_V1_SQL = f"""
    SELECT g.row_id, g.example_number, g.target_style, g.version_number, away, towards, sqrt(away * towards) AS style_score,
           (0.5 - 0.5 * cos(pi() * ratio)) * sqrt(least(1.0, greatest(0.0, (bert_score - 0.45) / 0.55)) * least(1.0, greatest(0.0, (labse_score - 0.2) / 0.8))) AS meaning,
           sqrt(1.0 / (8 * greatest(t - 4, 0) + 1) / (20 * greatest(t - greatest(s, 4), 0) + 1)) AS nat
    FROM ({_STYLE_SQL}) g JOIN (SELECT row_id, bert_score, labse_score, text_perplexity AS s, styled_text_perplexity AS t,
           coalesce(least(length(text), length(styled_text)) / nullif(greatest(length(text), length(styled_text)), 0)::DOUBLE, 0.0) AS ratio FROM tst_results
         WHERE text IS NOT NULL AND styled_text IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in _V1_COLUMNS)}) USING (row_id)
    WHERE away IS NOT NULL AND towards IS NOT NULL AND away * towards >= 0"""


def _complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "tst_results").select(
        "row_id", "example_number", "text", "author", "target_style", "tst_model", "version_number", "styled_text", "text_style_emb", "styled_text_style_emb", *_V1_COLUMNS
    ))
    rows = _nan_safe(rows, *_V1_COLUMNS).filter("text is not null and styled_text is not null and target_style is not null")
    rows = rows.filter(usable("text_style_emb") & usable("styled_text_style_emb"))
    styles = table(spark, sf_dir, "author_styles")
    known = rows.join(F.broadcast(styles.select(F.col("style").alias("target_style"))), "target_style", "left_semi")
    return A.with_centroids(known, styles)  # an unknown style would be an error here


@query(
    "version_one",
    f"""SELECT row_id, round(style_score, 6) AS style_score, round(meaning, 6) AS meaning_score, round(nat, 6) AS naturality_score, round(pow(style_score * meaning * nat, 1.0 / 3), 5) AS score
        FROM ({_V1_SQL})""",
)
def version_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All version-one scores of complete rows, with the centroid of their style as target."""
    out = version_one_scores(_complete(spark, sf_dir)).filter("style_score is not null")
    names = ["style_score", "meaning_score", "naturality_score"]
    return rounded(rounded(out.select("row_id", *names, "score"), *names), "score", digits=5)


@query(
    "evaluation",
    f"""SELECT style_set, round(avg(score), 5) AS mean_score, count(score) AS n FROM {_sets_sql()} LEFT JOIN (
          SELECT *, row_number() OVER (PARTITION BY example_number, target_style ORDER BY score DESC, version_number) AS k FROM (
            SELECT *, pow(style_score * meaning * nat, 1.0 / 3) AS score FROM ({_V1_SQL}) WHERE example_number IS NOT NULL)) b ON b.target_style = sets.style AND k = 1
        GROUP BY style_set""",
)
def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation plan over stored features: scores, the best version of each group, means of style sets."""
    sources = _complete(spark, sf_dir).withColumn("target_style_emb", F.col("centroid").cast("array<double>")).drop("centroid")
    return rounded(Evaluation(sources, model="stored").performance(sets=STYLE_SETS), "mean_score", digits=5)


@query(
    "kept_targets",
    f"""SELECT row_id, 'stored' AS tst_model, 0 AS version_number, round(sim, 6) AS target_style_sim_measure FROM (
          SELECT row_id, {_sim_sql("text_style_emb", "centroid")} AS sim FROM tst_results JOIN author_styles ON style = target_style WHERE {_usable_sql("text_style_emb")}) WHERE sim < 0.9""",
)
def kept_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose target is far enough from their source, as single versions with literal and chosen columns."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", "target_style", "styled_text", "text_style_emb")).filter(usable("text_style_emb"))
    known = A.with_centroids(rows, table(spark, sf_dir, "author_styles"), checked=False).filter("centroid is not null")
    far = A.near_target(known.withColumn("target_style_sim_measure", V.sim_measure("text_style_emb", "centroid")))
    one = R.single_version(far.withColumn("tst_model", F.lit("stored")))
    return rounded(R.project(one, ("row_id", "tst_model", "version_number", "target_style_sim_measure", "no_such_column"), ("row_id",)), "target_style_sim_measure")


@query("first_results", "SELECT row_id, example_number FROM tst_results ORDER BY example_number DESC NULLS LAST, row_id LIMIT 100")
def first_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred rows of the highest example numbers: the head of an order."""
    rows = table(spark, sf_dir, "tst_results").select("row_id", "example_number")
    return A.head(rows, 100, [F.col("example_number").desc_nulls_last(), F.col("row_id")])


@query(
    "united_texts",
    """SELECT domain, count(*) AS n, count(example_number) AS n_sources, count(pool_id) AS n_pool, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
         SELECT domain, text, example_number, NULL AS pool_id FROM test_df UNION ALL SELECT domain, text_chunk, NULL, pool_id FROM style_pool) GROUP BY domain""",
)
def united_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and pool by column name."""
    pool = table(spark, sf_dir, "style_pool").select("pool_id", F.col("text_chunk").alias("text"), "domain")
    rows = A.union_all(table(spark, sf_dir, "test_df").select("example_number", "domain", "text"), pool)
    return rows.groupBy("domain").agg(F.count("*").alias("n"), F.count("example_number").alias("n_sources"), F.count("pool_id").alias("n_pool"), F.sum(F.length("text")).alias("chars"))


@query(
    "string_similarity",
    """SELECT DISTINCT target_style, author, lower(target_style) = lower(author) AS same FROM tst_results WHERE target_style IS NOT NULL AND author IS NOT NULL""",
)
def string_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored styles and authors have a matching ratio of 1: those that are equal but for their case."""
    from tonewright.functions.strings import string_similarity as ratio

    rows = table(spark, sf_dir, "tst_results").select("target_style", "author").distinct().filter("target_style is not null and author is not null")
    return rows.select("target_style", "author", (ratio("target_style", "author") == 1.0).alias("same"))


@query(
    "model_inputs",
    r"""SELECT row_id, least(n, 64) + 1 AS n_gpt, least(n + 1, 64) AS n_t5, CAST(1 AS INTEGER) AS gpt_last, CAST(1 AS INTEGER) AS t5_first FROM (
          SELECT row_id, len(list_filter(string_split_regex(text, '[\s\x0b\x{85}\p{Z}]+'), lambda w: w <> '')) AS n FROM tst_results WHERE text IS NOT NULL)""",
)
def model_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of both model types with lengths of words as ids: the tag in front within the budget, or behind the cut text."""
    from tonewright.providers import GenerationConfig

    ids = F.transform(X.words("text"), lambda w: F.length(w) + 1)
    tag = F.array(F.lit(1))
    rows = table(spark, sf_dir, "tst_results").filter("text is not null").select("row_id", ids.alias("ids"))
    for kind in ("T5", "GPT"):
        rows = rows.withColumn(kind, GenerationConfig.of(max_input_length=64, max_output_length=64, model_type=kind).model_input("ids", tag))
    return rows.select("row_id", F.size("GPT").alias("n_gpt"), F.size("T5").alias("n_t5"), F.element_at("GPT", -1).alias("gpt_last"), F.element_at("T5", 1).alias("t5_first"))


@query(
    "target_kinds",
    f"""SELECT domain, example_number, CASE WHEN domain IN ({", ".join(f"'{d}'" for d in S.DOMAIN_ONLY)}) THEN 6 ELSE 12 END AS n_kinds, true AS allowed FROM test_df""",
)
def target_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many kinds of target a source may get, and whether the drawn one is among them."""
    from tonewright.operators.sampling import with_target_kind

    rows = with_target_kind(table(spark, sf_dir, "test_df").select("domain", "example_number"), "domain", "example_number", 3)
    full, short = (F.array(*[F.lit(s) for s in S.target_styles("", flag)]) for flag in (True, False))
    options = F.when(F.coalesce(F.col("domain").isin(S.DOMAIN_ONLY), F.lit(False)), short).otherwise(full)
    return rows.select("domain", "example_number", F.size(options).alias("n_kinds"), F.array_contains(options, F.col("target_style_desc")).alias("allowed"))
