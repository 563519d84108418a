"""The pN_ queries: each applies its operator, with production parameters, to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonewright.llm.defects import find_defects
from tonewright.llm.mixing import mix_sources
from tonewright.llm.neighbours import joint_collection, name_of, nearest, similar_pairs
from tonewright.llm.splits import assign_splits, related_authors
from tonewright.llm.splitting import split_oversized
from tonewright.llm.tokens import decode_corpus, encode_corpus
from tonewright.llm.topn import top_n_per_group
from tonewright.llm.truncation import find_truncated, truncation_rates
from tonewright.session import cut, spread, table


#: The text fields of the results and the source of each.
FIELDS = {"text": "domain", "styled_text": "tst_model"}


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "test_df").select("example_number", "author", "text"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut values of both text fields."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", *FIELDS))
    return find_truncated(rows, "row_id", FIELDS)


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each domain truncates ``text`` and each model ``styled_text``."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", *FIELDS, *FIELDS.values()))
    return truncation_rates(rows, "row_id", FIELDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different author values that must land in the same split."""
    return related_authors(_sources(spark, sf_dir), "example_number", "author", "text")


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every source row."""
    return assign_splits(_sources(spark, sf_dir), "example_number", "author", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three rows of each (example_number, target_style) by score."""
    rows = table(spark, sf_dir, "tst_results").select("example_number", "target_style", "row_id", "score")
    top = top_n_per_group(rows, ["example_number", "target_style"], "score", "row_id", 3)
    return top.select("example_number", "target_style", F.col("place").cast("int").alias("place"), "row_id")


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["row_id", "example_number", "text_style_emb", "styled_text_style_emb"]
    return cut(joint_collection(spread(table(spark, sf_dir, "tst_results").select(*columns))))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different vectors of the joint collection with a cosine of at least 0.9."""
    pairs = similar_pairs(_collection(spark, sf_dir), 64, 0.9).select(name_of("a").alias("x"), name_of("b").alias("y"))
    return pairs.select(F.least("x", "y").alias("vec_a"), F.greatest("x", "y").alias("vec_b"))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of each row and example whose number is divisible by 50, against all vectors."""
    vectors = _collection(spark, sf_dir).withColumn("asks", F.floor(F.col("id") / 2) % 50 == 0)
    near = nearest(vectors, 64, 10, "asks")
    return near.select(name_of("id").alias("vec"), "place", name_of("neighbour").alias("neighbour"), F.round("cosine", 6).alias("cosine"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The defective answers with their defect."""
    rows = spread(table(spark, sf_dir, "tst_results").select("row_id", *FIELDS))
    return find_defects(rows, "row_id", "text", "styled_text", FIELDS)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode_corpus(_documents(spark, sf_dir), "doc_id", "text")


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document decoded from its ids: its length, and whether it is the stored text again."""
    docs = table(spark, sf_dir, "documents")
    back = decode_corpus(p6_ids(spark, sf_dir), "doc_id", "ids").select("doc_id", F.length("text").alias("n_chars"), F.xxhash64("text").alias("back"))
    stored = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("stored"))
    return back.join(stored, "doc_id").select("doc_id", "n_chars", (F.col("back") == F.col("stored")).alias("same"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their copies."""
    return mix_sources(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")[0]


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached shares of each source of each mix."""
    return mix_sources(_documents(spark, sf_dir), table(spark, sf_dir, "mix_targets"), "doc_id", "text", "source")[1]


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document beyond the limit of each setting."""
    return split_oversized(_documents(spark, sf_dir), table(spark, sf_dir, "split_limits"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_rates": p1_rates,
        "p2_found": p2_found,
        "p2_splits": p2_splits,
        "p3_found": p3_found,
        "p4_found": p4_found,
        "p4_nearest": p4_nearest,
        "p5_found": p5_found,
        "p6_ids": p6_ids,
        "p6_decoded": p6_decoded,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p8_pieces": p8_pieces,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB statements for the queries that SQL can express over whole tables."""
    return {
        "p3_found": """
            SELECT example_number, target_style, place, row_id FROM (
              SELECT example_number, target_style, row_id,
                     CAST(row_number() OVER (PARTITION BY example_number, target_style
                                             ORDER BY score DESC, row_id) AS INTEGER) AS place
              FROM tst_results
              WHERE score IS NOT NULL AND NOT isnan(score) AND NOT isinf(score)
                AND target_style IS NOT NULL AND example_number IS NOT NULL)
            WHERE place <= 3""",
        "p6_decoded": "SELECT doc_id, CAST(coalesce(length(text), 0) AS INTEGER) AS n_chars, true AS same FROM documents",
    }
