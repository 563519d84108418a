"""Queries of sampling and of the assembly of training rows.

What is drawn by hash no other engine can repeat, so such queries tell what every draw has to keep: how many, from where, of
which norm; their SQL counterparts say the same from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.functions import text as X
from tonewright.functions import vector as V
from tonewright.operators import sampling as P
from tonewright.operators import segment as C
from tonewright.plans.pairs import _words_sql
from tonewright.plans.registry import _usable_sql, query, rounded, usable
from tonewright.session import spread, table

_NORM = "sqrt(list_inner_product(CAST({0} AS DOUBLE[]), CAST({0} AS DOUBLE[])))"


@query(
    "drawn_targets",
    f"""SELECT row_id, 2 AS n_keys, true AS different, true AS from_pool, round({_NORM.format("text_style_emb")}, 3) AS norm FROM tst_results WHERE {_usable_sql("text_style_emb")}""",
)
def drawn_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two other domains drawn and mixed for every source with a usable vector: two keys, none the row's own, both of the pool, at
    the norm of the source."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", "domain", "text_style_emb")).filter(usable("text_style_emb"))
    pool = table(spark, sf_dir, "style_pool").filter(usable("text_style_emb"))
    out = P.draw_targets(rows, pool, "domain", "row_id", 2)
    names = pool.filter("domain is not null").agg(F.collect_set("domain").alias("_names"))  # the few domains
    a, b = F.col("target_keys")[0], F.col("target_keys")[1]
    different = (a != b) & ~a.eqNullSafe(F.col("domain")) & ~b.eqNullSafe(F.col("domain"))
    known = F.array_contains("_names", a) & F.array_contains("_names", b)
    out = out.crossJoin(F.broadcast(names)).select("row_id", F.size("target_keys").alias("n_keys"), different.alias("different"), known.alias("from_pool"), V.norm("target_style_emb").alias("norm"))
    return rounded(out, "norm", digits=3)


@query(
    "pool_numbers",
    f"""SELECT author, count(*) AS n, count(*) AS n_numbers, 0::BIGINT AS first, count(*) - 1 AS last FROM style_pool
        WHERE author IS NOT NULL AND {_usable_sql("text_style_emb")} GROUP BY author""",
)
def pool_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of a pool's vectors in their author: each from 0 on, once."""
    indexed, _ = P.pool_index(table(spark, sf_dir, "style_pool").filter(usable("text_style_emb")), "author", "text_style_emb")
    number = F.col("_ordinal").cast("long")
    return indexed.groupBy(F.col("_key").alias("author")).agg(
        F.count("*").alias("n"), F.countDistinct(number).alias("n_numbers"), F.min(number).alias("first"), F.max(number).alias("last")
    )


@query(
    "added_targets",
    f"""SELECT row_id, kind, CASE WHEN contains(kind, '2_') THEN 2 ELSE 1 END AS n_keys, round({_NORM.format("text_style_emb")}, 3) AS norm, true AS of_kind FROM (
          SELECT *, list_extract(['other_author', '2_authors_weighted_avg_with_noise', 'other_domain_with_negations', '2_domains_weighted_avg'], CAST(row_id % 4 AS INTEGER) + 1) AS kind FROM tst_results)
        WHERE {_usable_sql("text_style_emb")}""",
)
def added_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of four kinds, plain, noisy and negated: as many keys as the kind has, of its pool, at the norm of the source."""
    kinds = F.array(*[F.lit(k) for k in ("other_author", "2_authors_weighted_avg_with_noise", "other_domain_with_negations", "2_domains_weighted_avg")])
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", "author", "domain", "text_style_emb")).filter(usable("text_style_emb"))
    rows = rows.withColumn("target_style_desc", F.get(kinds, (F.col("row_id") % 4).cast("int")))
    pool = table(spark, sf_dir, "style_pool").filter(usable("text_style_emb"))
    out = P.add_targets(rows, pool, pool.filter("author is not null"), "row_id", 5)
    names = pool.agg(F.collect_set("domain").alias("_d"), F.collect_set("author").alias("_a"))  # the settings of the pool
    kind = F.col("target_style_desc")
    of_kind = F.forall("target_keys", lambda k: F.when(kind.contains("domain"), F.array_contains("_d", k)).otherwise(F.array_contains("_a", k)))
    out = out.crossJoin(F.broadcast(names)).select("row_id", kind.alias("kind"), F.size("target_keys").alias("n_keys"), V.norm("target_style_emb").alias("norm"), of_kind.alias("of_kind"))
    return rounded(out, "norm", digits=3)


@query(
    "segmented_chapters",
    f"""SELECT author, title, chapter_pos, count(*) AS n_sentences, CAST(least(greatest(1, round_even(sum(n) / 40.0, 0)), count(*)) AS INTEGER) AS n_chunks, true AS in_order,
               CAST(sum(length(text_ru)) + count(*) - least(greatest(1, round_even(sum(n) / 40.0, 0)), count(*)) AS BIGINT) AS chars
        FROM (SELECT *, len({_words_sql("text_ru")}) AS n FROM book_chapters WHERE length(text_ru) > 0) GROUP BY author, title, chapter_pos""",
)
def segmented_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters cut into chunks and assembled: all sentences once, in order, in the right number of chunks, joined by a space."""
    cut = C.segment_chapters(table(spark, sf_dir, "book_chapters"), P.Gamma(40, 5, 200))
    keys = ["author", "title", "chapter_pos"]
    chunks = C.assemble(cut, ["text_source_opt1", "text_source_opt2"], seed=7)
    texts = chunks.groupBy(*keys).agg(F.sum(F.length("target")).alias("chars"), F.count("*").alias("n_chunks"))
    ranges = cut.groupBy(*keys, "chunk").agg(F.min("sent_no").alias("a"), F.max("sent_no").alias("b"), F.count("*").alias("n"))
    whole = F.every((F.col("b") - F.col("a") + 1 == F.col("n")))
    sums = ranges.groupBy(*keys).agg(F.sum("n").alias("n_sentences"), (whole & (F.min("chunk") == 0) & (F.max("chunk") == F.count("*") - 1)).alias("in_order"))
    same = [sums[k].eqNullSafe(texts[k]) for k in keys]
    return sums.join(texts, same).select(*[sums[k] for k in keys], "n_sentences", F.col("n_chunks").cast("int").alias("n_chunks"), "in_order", "chars")


@query(
    "nearest_cuts",
    f"""WITH RECURSIVE s AS (SELECT author, title, chapter_pos, text_ru, sent_pos, len({_words_sql("text_ru")}) AS n FROM book_chapters WHERE length(text_ru) > 0),
        o AS (SELECT *, sum(n) OVER (PARTITION BY author, title, chapter_pos ORDER BY sent_pos, text_ru ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY author, title, chapter_pos) AS total FROM s),
        g AS (SELECT author, title, chapter_pos, list(upto / total::DOUBLE ORDER BY upto)[1:-2] AS ends, CAST(least(greatest(1, round_even(any_value(total) / 40.0, 0)), count(*)) AS INTEGER) AS k FROM o GROUP BY ALL),
        dp(author, title, chapter_pos, ends, k, r, best) AS (
          SELECT author, title, chapter_pos, ends, k, 0, list_transform(range(len(ends) + 1), lambda x: 0.0::DOUBLE) FROM g
          UNION ALL
          SELECT author, title, chapter_pos, ends, k, r + 1,
                 list_transform(range(len(ends) + 1), lambda c: CASE WHEN c < r + 1 THEN 1e9 ELSE list_min(list_transform(range(r + 1, c + 1), lambda e: abs(ends[e] - (r + 1)::DOUBLE / k) + best[e])) END)
          FROM dp WHERE r + 1 < k)
        SELECT author, title, chapter_pos, k AS n_chunks, round(best[-1], 5) AS cost FROM dp WHERE r = k - 1""",
)
def nearest_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters cut into chunks of even length: how far the cuts lie from where they should, which no other cuts undercut."""
    cut = C.segment_chapters(table(spark, sf_dir, "book_chapters"), P.Uniform(40.0, 40.0))
    keys = ["author", "title", "chapter_pos"]
    chunks = cut.groupBy(*keys, "chunk", "n_chunks").agg(F.sum(F.size(X.words("text_ru"))).alias("n"))
    lists = chunks.groupBy(*keys, "n_chunks").agg(F.array_sort(F.collect_list(F.struct("chunk", "n"))).alias("parts"))  # the chunks of a chapter
    shares = X.running_shares(F.transform("parts", lambda p: p["n"]))
    cost = F.aggregate(F.transform(shares, lambda x, i: F.abs(x - (i + 1) / F.col("n_chunks"))), F.lit(0.0), lambda s, x: s + x)
    return rounded(lists.select(*keys, "n_chunks", cost.alias("cost")), "cost", digits=5)


@query(
    "pair_tokens",
    f"""SELECT row_id, least(s + 1, 31) + 1 AS n_t5, least(t, 31) + 1 AS n_t5_labels, least(s, 31) + 1 + least(t, 31) + 1 AS n_gpt, least(s, 31) + 1 AS n_masked,
               (SELECT max(least(s, 31) + 1 + least(t, 31) + 1) FROM (SELECT len({_words_sql("text")}) AS s, len({_words_sql("styled_text")}) AS t, row_id // 8 AS b FROM tst_results
                  WHERE text IS NOT NULL AND styled_text IS NOT NULL) q WHERE q.b = p.b) AS n_padded
        FROM (SELECT row_id, row_id // 8 AS b, len({_words_sql("text")}) AS s, len({_words_sql("styled_text")}) AS t FROM tst_results WHERE text IS NOT NULL AND styled_text IS NOT NULL) p""",
)
def pair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, labels and padding of training pairs of both model types, with lengths of words as ids."""
    rows = table(spark, sf_dir, "tst_results").filter("text is not null and styled_text is not null")
    rows = rows.select("row_id", F.transform(X.words("text"), F.length).alias("s"), F.transform(X.words("styled_text"), F.length).alias("t"))
    t5, gpt = C.pair_input("s", "t", "T5", 32, 2, F.array(F.lit(1))), C.pair_input("s", "t", "GPT", 32, 2)
    rows = rows.select("row_id", F.floor(F.col("row_id") / 8).alias("b"), t5["input_ids"].alias("i5"), t5["labels"].alias("l5"), gpt["input_ids"].alias("ids"), gpt["labels"].alias("labels"))
    masked = F.size(F.filter("labels", lambda x: x == -100))
    rows = rows.withColumn("n_masked", masked).withColumn("n_gpt", F.size("ids"))
    out = C.padded(rows, {"ids": 0, "labels": -100}, "b")
    return out.select("row_id", F.size("i5").alias("n_t5"), F.size("l5").alias("n_t5_labels"), "n_gpt", "n_masked", F.size("labels").alias("n_padded"))


@query(
    "interleaved_mix",
    """SELECT c.child, true AS near_share, true AS even, c.n AS size FROM (VALUES (0, 'news'), (1, 'forum'), (2, 'prose')) AS k(child, source)
       JOIN (SELECT CASE source WHEN 'news' THEN 0 WHEN 'forum' THEN 1 ELSE 2 END AS child, count(*) AS n FROM documents WHERE source IN ('news', 'forum', 'prose') GROUP BY 1) c USING (child)""",
)
def interleaved_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as there are documents, interleaved from news, forum and prose by weight: each child's share of the draws is
    near its weight, and its rows come round equally often."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    names, weights = ("news", "forum", "prose"), (0.5, 0.3, 0.2)
    children = [docs.filter(F.col("source") == s) for s in names]
    total = docs.count()
    drawn = P.interleaved(children, weights, total, 7)
    times = drawn.groupBy("child", "doc_id").agg(F.count("*").alias("times"))
    sums = times.groupBy("child").agg(F.sum("times").alias("n"), F.min("times").alias("low"), F.max("times").alias("high"), F.count("*").alias("used"))
    sizes = docs.groupBy("source").agg(F.count("*").alias("size"))
    kinds = spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(names, weights))], "child int, source string, w double")
    met = F.broadcast(kinds).join(sizes, "source").join(sums, "child")
    low = F.when(F.col("used") < F.col("size"), 0).otherwise(F.col("low"))
    return met.select("child", (F.abs(F.col("n") / total - F.col("w")) < 4 / F.sqrt(F.lit(float(total)))).alias("near_share"), (F.col("high") - low <= 1).alias("even"), "size")


@query(
    "sampled_epochs",
    """SELECT e AS epoch, least(count(*), 500) AS n, least(count(*), 500) AS n_places FROM documents, range(3) AS r(e) WHERE text IS NOT NULL GROUP BY e""",
)
def sampled_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three epochs of at most 500 documents (the feature), each in an order of its own."""
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id")
    drawn = P.epochs(rows, 3, 11, "doc_id", max_samples=500)
    return drawn.groupBy(F.col("epoch").cast("long").alias("epoch")).agg(F.count("*").alias("n"), F.countDistinct("position_key").alias("n_places"))


@query(
    "expected_lengths",
    f"""SELECT author, round((lo + hi) / 2, 4) AS even, round(CASE WHEN hi > lo THEN (hi - lo) / ln(hi / lo) ELSE lo END, 4) AS log_even, round(m, 4) AS gamma, round(0.25 * (lo + hi) / 2 + 0.75 * m, 4) AS mixture
        FROM (SELECT author, min(n)::DOUBLE AS lo, max(n)::DOUBLE AS hi, avg(n) AS m FROM (SELECT author, len({_words_sql("text_ru")}) AS n FROM book_chapters WHERE length(text_ru) > 0) WHERE n > 0 GROUP BY author)""",
)
def expected_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected lengths of samplers fitted to the sentences of each author."""
    rows = table(spark, sf_dir, "book_chapters").filter(F.length("text_ru") > 0).select("author", F.size(X.words("text_ru")).alias("n")).filter("n > 0")
    stats = rows.groupBy("author").agg(F.min("n").cast("double").alias("lo"), F.max("n").cast("double").alias("hi"), F.avg("n").alias("m"))
    lo, hi, m = F.col("lo"), F.col("hi"), F.col("m")
    even = P.Uniform.mean_of(lo, hi)
    out = stats.select("author", even.alias("even"), P.LogUniform.mean_of(lo, hi).alias("log_even"), m.alias("gamma"), P.Mixture.mean_of([even, m], [0.25, 0.75]).alias("mixture"))
    return rounded(out, "even", "log_even", "gamma", "mixture", digits=4)


def _lengths_sql(text: str) -> str:
    return f"list_transform({_words_sql(text)}, lambda w: CAST(length(w) AS BIGINT))"


@query(
    "training_pairs",
    f"""SELECT row_id, least(len(s), 31) + 1 AS n_t5, least(len(t), 31) + 1 AS n_labels, len(g) AS n_gpt, CAST(list_sum(g) AS BIGINT) AS gpt_sum FROM (
          SELECT row_id, s, t, list_concat(s, [2::BIGINT], t, [2::BIGINT])[1:32] AS g FROM (SELECT row_id, {_lengths_sql("text")} AS s, {_lengths_sql("styled_text")} AS t FROM tst_results
            WHERE text IS NOT NULL AND styled_text IS NOT NULL))""",
)
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pairs as training rows of both model types, with lengths of words as ids."""
    rows = table(spark, sf_dir, "tst_results").filter("text is not null and styled_text is not null")
    rows = rows.select(F.col("text").alias("source"), F.col("styled_text").alias("target"), F.col("row_id").alias("target_style_emb"))
    lengths = lambda c: F.transform(X.words(c), F.length)
    t5 = C.training_frame(rows, lengths, "T5", 32, 2).select(F.col("style").alias("row_id"), F.size("input_ids").alias("n_t5"), F.size("labels").alias("n_labels"))
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("gpt_sum")
    gpt = C.training_frame(rows, lengths, "GPT", 32, 2).select(F.col("style").alias("row_id"), F.size("attention_mask").alias("n_gpt"), total)
    return t5.join(gpt, "row_id")


@query(
    "chapter_ids",
    f"""WITH s AS (SELECT author, title, chapter_pos, e, {_lengths_sql("text_ru")} AS t, coalesce(CASE WHEN len({_words_sql("text_source_opt1")}) > 0 THEN {_lengths_sql("text_source_opt1")} END,
                          CASE WHEN len({_words_sql("text_source_opt2")}) > 0 THEN {_lengths_sql("text_source_opt2")} END, []) AS o FROM book_chapters, range(2) AS r(e) WHERE length(text_ru) > 0),
        c AS (SELECT author, title, chapter_pos, e, CAST(least(greatest(1, round_even(sum(len(t)) / 40.0, 0)), count(*)) AS BIGINT) AS k, CAST(sum(coalesce(list_sum(t), 0)) AS BIGINT) AS ts,
                     CAST(sum(coalesce(list_sum(o), 0)) AS BIGINT) AS os, count(*) AS n FROM s GROUP BY ALL)
        SELECT author, title, chapter_pos, e AS epoch, k AS n_chunks, ts + os + 1000 * 2 * (n - k) + 2 * 2 * k AS ids FROM c""",
)
def chapter_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of two epochs as training rows of ids: all ids of all sentences, a space between two of a chunk, two end marks a chunk."""
    rows = table(spark, sf_dir, "book_chapters")
    cut = C.segment_chapters(rows, P.Gamma(40, 5, 200), n_epochs=2)
    lengths = {c: F.transform(X.words(c), F.length) for c in ("text_ru", "text_source_opt1", "text_source_opt2")}
    keys = ("author", "title", "chapter_pos", "epoch")
    ids = C.assemble_ids(cut.withColumns(lengths), ["text_source_opt1", "text_source_opt2"], "text_ru", "GPT", 100_000, 2, space=1000, keys=keys)
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda s, x: s + x)
    out = ids.select(*keys, total.alias("ids")).groupBy(*keys).agg(F.count("*").alias("n_chunks"), F.sum("ids").alias("ids"))
    return out.withColumn("epoch", F.col("epoch").cast("long"))
