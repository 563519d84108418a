import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.functions import vector as V
from tonewright.operators import consistency as G
from tonewright.operators import reshape as R
from tonewright.operators import sampling as P
from tonewright.operators import segment as C
from tonewright.operators import select as A
from tonewright.operators import spans as Z


def test_best_version_ties_nulls_and_order(spark):
    nan = float("nan")
    rows = [(1, "a", 0, 0.2), (1, "a", 1, 0.9), (1, "a", 2, 0.9), (1, "a", 3, nan), (2, "a", 0, None), (None, "a", 0, 1.0), (3, "b", 1, -1.0)]
    df = spark.createDataFrame(rows, "example_number long, target_style string, version_number int, score double")
    for frame in (df, df.orderBy(F.desc("version_number")).repartition(3)):
        got = {(r["example_number"], r["version_number"]) for r in A.best_version(frame).collect()}
        assert got == {(1, 1), (3, 1)}


def test_final_performance_overlap(spark):
    best = spark.createDataFrame([("x", 1.0), ("y", 0.0), ("z", 0.5)], "target_style string, score double")
    got = {r["style_set"]: (r["mean_score"], r["n"]) for r in A.final_performance(best, sets={"A": ["x"], "B": ["x", "y"], "C": ["q"]}).collect()}
    assert got == {"A": (1.0, 1), "B": (0.5, 2), "C": (None, 0)}


KEPT = dict(chrf=0.5, bi_score=0.05, cl_score=0.05, gender_score=0.9, entity_score=0.9, meaning_score=0.9, tst_result_style_sim=0.5, nat_v2=0.9, gender_activated=True)


@pytest.mark.parametrize(
    "change, want",
    [({}, True), ({"chrf": 0.75}, False), ({"bi_score": 0.12}, False), ({"cl_score": 0.10}, False), ({"gender_score": 0.69}, False), ({"gender_score": 0.70}, True),
     ({"gender_score": 0.1, "gender_activated": False}, True), ({"entity_score": 0.70}, True), ({"meaning_score": 0.75}, False), ({"tst_result_style_sim": 0.92}, False), ({"nat_v2": 0.75}, True), ({"nat_v2": 0.74}, False)],
)
def test_keep_mask(spark, change, want):
    df = spark.createDataFrame([KEPT | change])
    assert df.select(A.keep_mask(df)).first()[0] is want


def test_keep_mask_missing(spark):
    df = spark.createDataFrame([KEPT | {"nat_v2": float("nan")}])
    with pytest.raises(Exception, match="missing score"):
        df.select(A.keep_mask(df)).collect()
    with pytest.raises(KeyError):
        A.keep_mask(df.drop("chrf"))
    fine = spark.createDataFrame([KEPT | {"gender_score": float("nan"), "gender_activated": False}])
    assert fine.select(A.keep_mask(fine)).first()[0] is True


def test_own_style_keeps_null_author(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id long, author string")
    styles = spark.createDataFrame([("x",), ("y",)], "style string")
    assert sorted((r["id"], r["target_style"]) for r in R.other_styles(df, styles).collect()) == [(1, "y"), (2, "x"), (2, "y")]


def test_expand_versions(spark):
    df = spark.createDataFrame([(1, "t", ["a", "b"], 9)], "example_number long, text string, versions array<string>, extra int")
    out = R.expand_versions(df, "versions")
    assert out.columns == ["example_number", "text", "version_number", "styled_text"] and out.count() == 2
    ragged = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"])], "example_number long, versions array<string>")
    with pytest.raises(Exception, match="different lengths"):
        R.expand_versions(ragged, "versions").collect()


def _pool(spark):
    rows = [(a, [float(i + 1), float(j + 1), 1.0, 0.0]) for i, a in enumerate("abc") for j in range(3)]
    return spark.createDataFrame(rows, "author string, text_style_emb array<double>")


def test_draws_are_other_distinct_and_stable(spark):
    df = spark.createDataFrame([(i, "abcz"[i % 4] if i % 5 else None, [3.0, 4.0, 0.0, 0.0]) for i in range(60)], "id long, author string, text_style_emb array<double>")
    first = P.draw_targets(df, _pool(spark), "author", "id", 2).withColumn("n", V.norm("target_style_emb")).collect()
    for r in first:
        assert r["author"] not in r["target_keys"] and len(set(r["target_keys"])) == 2 and r["n"] == pytest.approx(5)
    again = P.draw_targets(df.repartition(7), _pool(spark), "author", "id", 2).collect()
    assert {r["id"]: r["target_keys"] for r in first} == {r["id"]: r["target_keys"] for r in again}


def test_weighted_draws_follow_weights(spark):
    df = spark.range(3000).select("id", F.lit(None).cast("string").alias("author"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("text_style_emb"))
    got = P.draw_targets(df, _pool(spark), "author", "id", 1, weights=spark.createDataFrame([("a", 0.7), ("b", 0.3)], "key string, weight double")).groupBy(F.col("target_keys")[0].alias("k")).count().collect()
    counts = {r["k"]: r["count"] for r in got}
    assert set(counts) == {"a", "b"} and 0.66 < counts["a"] / 3000 < 0.74


def test_add_targets_kinds(spark):
    pool = spark.createDataFrame([(a, d, [1.0 + i, 2.0]) for i, (a, d) in enumerate([("a", "x"), ("b", "x"), ("c", "y"), (None, "z")])], "author string, domain string, text_style_emb array<double>")
    df = spark.createDataFrame([(i, "a", "x", [1.0, 0.0]) for i in range(40)], "example_number long, author string, domain string, text_style_emb array<double>")
    kinds = P.with_target_kind(df, "domain", "example_number", 1, has_author_targets=True)
    out = P.add_targets(kinds, pool, pool, "example_number", target_norm=1.0).collect()
    assert len(out) == 40 and len({r["target_style_desc"] for r in out}) > 6
    for r in out:
        assert np.linalg.norm(r["target_style_emb"]) == pytest.approx(1) and not {"a", "x"} & set(r["target_keys"])
    with pytest.raises(Exception, match="unknown target kind"):
        P.add_targets(df.withColumn("target_style_desc", F.lit("?")), pool, pool, "example_number").collect()


def test_samplers_mean():
    rng = np.random.default_rng(1)
    for s in (P.Uniform(10, 30), P.LogUniform(10, 100), P.Mixture((P.Uniform(1, 3), P.Uniform(7, 9)), (1.0, 3.0))):
        assert s.sample(rng, 40_000).mean() == pytest.approx(s.mean(), rel=0.03)
    g = P.Gamma(50, 5, 100).sample(rng, 1000)
    assert g.min() >= 5 and g.max() <= 100


def test_interleaved(spark):
    a, b = (spark.range(n).withColumn("c", F.lit(c)) for n, c in ((3, "a"), (50, "b")))
    rows = P.interleaved([a, b], [0.25, 0.75], 200, 5).collect()
    assert sorted(r["draw"] for r in rows) == list(range(200))
    from collections import Counter

    counts = Counter(r["c"] for r in rows)
    assert 30 < counts["a"] < 75
    per = Counter(r["id"] for r in rows if r["c"] == "a")
    assert max(per.values()) - min(per.values()) <= 1


def test_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(300):
        m = rng.randrange(1, 8)
        n = rng.randrange(0, m + 1)
        ends, chunks = sorted(rng.random() for _ in range(m)), sorted(rng.random() for _ in range(n))
        got = C.place_cuts(chunks, ends)
        cost = lambda c: sum(abs(ends[i] - x) for i, x in zip(c, chunks))  # noqa: B023, E731
        assert all(a < b for a, b in zip(got, got[1:])) and len(got) == n
        assert cost(got) == pytest.approx(min(map(cost, itertools.combinations(range(m), n))))
    assert C.place_cuts([0.5], [0.4, 0.6]) == [1]
    assert C.chunk_ranges([], 3) == [(0, 3)] and C.chunk_ranges([0, 1], 4) == [(0, 1), (1, 2), (2, 4)]


def test_segments_cover_chapters(spark):
    rows = [("a", "t", c, s, f"сло во {s} " * 3, "x" if s % 2 else "", "y") for c in (1, 2) for s in range(9)] + [("a", "t", 3, 0, None, "x", "y")]
    df = spark.createDataFrame(rows, "author string, title string, chapter_pos int, sent_pos int, text_ru string, o1 string, o2 string")
    cut = C.segment_chapters(df, P.Uniform(20, 30))
    got = sorted((r["chapter_pos"], r["sent_no"], r["chunk"], r["n_chunks"]) for r in cut.collect())
    assert len(got) == 18 and all(c < n for _, _, c, n in got) and {n for *_, n in got} == {3}
    chunks = C.assemble(cut, ["o1", "o2"]).collect()
    assert sum(r["n_sentences"] for r in chunks) == 18 and set(" ".join(r["source"] for r in chunks).split()) == {"x", "y"}


def test_pair_input_and_padding(spark):
    df = spark.createDataFrame([([1, 2, 3], [4, 5]), ([1], [2])], "s array<int>, t array<int>")
    gpt = df.select(*[c.alias(k) for k, c in C.pair_input("s", "t", "GPT", 3, 9).items()]).collect()
    assert gpt[0]["input_ids"] == [1, 2, 9, 4, 5, 9] and gpt[0]["labels"] == [-100, -100, -100, 4, 5, 9]
    t5 = df.select(*[c.alias(k) for k, c in C.pair_input("s", "t", "T5", 3, 9).items()], F.lit(0).alias("b"))
    assert t5.first()["input_ids"] == [1, 2, 9]
    assert all(len(r["labels"]) == 3 for r in C.padded(t5, {"labels": -100}, "b").collect())


TEXT = "Утром шёл дождь, потом снег. Кот спал; пёс лаял — громко. Всё."


def test_span_removal():
    scores = [0.1] * len(TEXT.split())
    assert Z.remove_spans(TEXT, scores) == TEXT
    tail = list(scores)
    tail[3:5] = [0.9, 0.9]
    assert Z.remove_spans(TEXT, tail) == "Утром шёл дождь Кот спал; пёс лаял — громко. Всё."
    head = list(scores)
    head[5:7] = [0.9, 0.9]
    assert "Пёс лаял" in Z.remove_spans(TEXT, head)
    assert Z.drop_sentences(TEXT, [0.9] * 5 + [0.0] * 20).startswith("Кот спал")
    assert Z.removed_spans(TEXT, [], 0.4) == []
    with pytest.raises(ValueError):
        Z.removed_spans(TEXT, scores, strategy="?")
    longest = Z.removed_spans(TEXT, [0.9] * 30, strategy="longest_above_thr")
    assert longest == Z.sentences(TEXT)
    assert Z.best_removal("s", TEXT, tail, lambda s, t: (0.0, [0.0])) != TEXT


def test_alignment_scores(spark):
    rows = [("a b c", "a b c", [(0, 0), (1, 1), (2, 2)]), ("a b", "a x y z q", [(0, 0)]), ("", "a", []), ("a", "b", None)]
    df = spark.createDataFrame(rows, f"text string, styled_text string, edges {G.EDGES}")
    got = G.alignment_scores(df, score="span").collect()
    assert [r["bi_score"] for r in got] == [0, pytest.approx(0.8), 0, 0]
    rolling = G.alignment_scores(df).collect()
    assert rolling[1]["cl_word_mask"][0]["word"] == "b" and rolling[3]["bi_score"] == 1.0


def test_itermax_identity():
    s = np.eye(4) + 0.01
    assert G.itermax(s) == [(i, i) for i in range(4)]


def test_entities(spark):
    raw = [dict(entity_group=g, word=w, start=s, end=e) for g, w, s, e in [("FIRST_NAME", "Иван", 0, 4), ("LAST_NAME", "Петров", 5, 11), ("CITY", "##ск", 12, 14), ("COUNTRY", "Российской", 20, 30), ("COUNTRY", "Федерации", 31, 40), ("STREET", "Мира", 50, 54)]]
    found, spans = G.parse_entities(raw)
    assert found == {"PERSON": ["Иван Петров"], "COUNTRY": ["Российской Федерации"]} and spans == [(0, 11), (20, 40)]
    df = spark.createDataFrame([(found, {"FIRST_NAME": ["Ивану"], "CITY": ["Москва"]}), (None, None)], f"source_entities {G.ENTITIES}, target_entities {G.ENTITIES}")
    assert [r["entity_score"] for r in G.entity_scores(df).collect()] == [0.5, 1.0]


def test_gender(spark):
    tags = "array<struct<word:string,tag:string>>"
    pron, masc, fem = ("я", "PRON|Number=Sing"), ("шёл", "VERB|Gender=Masc|Number=Sing|Tense=Past"), ("шла", "VERB|Gender=Fem|Number=Sing|Tense=Past")
    rows = [([pron, masc], [pron, fem], [(0, 0)], {0: "Masc"}, {0: "Fem"}), ([masc], [fem], [], {}, {})]
    df = spark.createDataFrame(rows, f"source_tags {tags}, target_tags {tags}, edges {G.EDGES}, source_gender map<int,string>, target_gender map<int,string>")
    a, b = G.gender_scores(df).collect()
    assert (a["gender_score"], a["gender_activated"], a["has_switch"]) == (0.0, True, True)
    assert (b["gender_score"], b["gender_activated"]) == (1.0, False)
    assert G.gender_map("Я шла, да", [(0, 1, None), (2, 5, "VERB|Gender=Fem"), (5, 6, "PUNCT")]) == {1: "Fem"}
