"""Whole-pair scorers, configurations, draws and stores: small cases with known results, and odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from tonewright.functions import text as X
from tonewright.operators import consistency as G
from tonewright.operators import reshape as R
from tonewright.operators import sampling as P
from tonewright.operators import spans as Z
from tonewright.providers import ByBatch, GenerationConfig, via_translation
from tonewright.sources import sink


def _equal_words(df):
    pairs = F.transform(X.words("text"), lambda w, i: F.struct(i.alias("i"), (F.array_position(X.words("styled_text"), w) - 1).cast("int").alias("j")))
    return df.withColumn("edges", F.filter(pairs, lambda e: e["j"] >= 0))


def test_score_pairs_with_odd_rows(spark):
    rows = [(1, "a b c d", "a b c d"), (2, "a b", "x y z w v"), (3, None, "x"), (4, "", ""), (5, "a b", "x y z w v"), (6, "a " * 30, "b"), (7, None, None)]
    df = spark.createDataFrame(rows, "id long, text string, styled_text string")
    over = F.size(X.words("text")) > 20
    got = {r["id"]: r for r in G.score_pairs(df, "text", "styled_text", _equal_words, over=over).collect()}
    assert len(got) == 7 and got[1]["bi_score"] == 0 and got[2]["bi_score"] == got[5]["bi_score"] == 1.0 and got[2]["has_bi"]
    assert got[6]["unhandled"] and not got[6]["from_fallback"] and not got[1]["unhandled"] and got[4]["bi_score"] == 0
    far = {r["id"]: r for r in G.score_pairs(df.filter("id in (1, 6)"), "text", "styled_text", _equal_words, fallback=_equal_words, over=over).collect()}
    assert far[6]["from_fallback"] and not far[6]["unhandled"] and far[6]["bi_score"] == 1.0
    assert G.score_pairs(df.limit(0), "text", "styled_text", _equal_words).collect() == []


def test_ensemble_gates_and_cleans(spark):
    source = "кот спит дома"
    target = "Кот спит дома. Вдруг пришёл очень большой и страшный серый злой волк."
    rows = [(1, source, target), (2, source, source), (3, "", target)]
    df = _equal_words(spark.createDataFrame(rows, "id long, text string, styled_text string"))
    df = df.withColumn("p", F.transform(X.words("styled_text"), lambda w: F.lit(1.0))).withColumn("q", F.array().cast("array<double>"))
    a, b, c = G.ensemble(df, "text", "styled_text", "edges", "p", "q").orderBy("id").collect()
    assert a["has_bi"] and len(a["bi_word_scores"]) == 12 and len(a["cleaned_text"]) < len(target)
    assert not b["has_bi"] and b["cleaned_text"] == source and max(b["bi_word_scores"]) == pytest.approx(0.2) and not b["has_cl"]
    assert c["bi_word_scores"] == [] and c["cleaned_text"] == target


def test_entity_pair_scores(spark):
    raw = "array<struct<entity_group:string,word:string,start:int,end:int>>"
    known = {"Иван в Москве": [("FIRST_NAME", "Иван", 0, 4), ("CITY", "Москве", 7, 13)], "Ивану в Тверь": [("FIRST_NAME", "Ивану", 0, 5), ("CITY", "Тверь", 8, 13)]}
    table = spark.createDataFrame([(k, v) for k, v in known.items()], f"text string, raw {raw}")
    rows = [(1, "Иван в Москве", "Ивану в Тверь", 0.3), (2, "Иван в Москве", "Иван в Москве", 0.9), (3, "", "Ивану в Тверь", 0.1), (4, None, None, None), (5, "нет имён", "Иван в Москве", 1.0)]
    df = spark.createDataFrame(rows, "id long, text string, styled_text string, precision double")
    got = {r["id"]: r for r in G.entity_pair_scores(df, "text", "styled_text", lambda t: t.join(table, "text", "left"), precision="precision").collect()}
    assert got[1]["entity_score"] == 0.5 and got[1]["has_substitution"] and got[1]["combined_entity_score"] == 0.3
    assert got[2]["entity_score"] == 1.0 and not got[2]["has_substitution"] and got[2]["combined_entity_score"] == 0.9
    assert got[3]["entity_score"] == got[3]["combined_entity_score"] == got[4]["entity_score"] == 1.0 and got[5]["entity_score"] == 0.0


def test_gender_of_blank_sides(spark):
    tags = "array<struct<word:string,tag:string>>"
    pron, fem = ("она", "PRON|Gender=Fem|Number=Sing"), ("шла", "VERB|Gender=Fem|Number=Sing|Tense=Past")
    rows = [(1, "она шла", " ", [pron, fem], []), (2, None, "шла", [], [fem])]
    df = spark.createDataFrame(rows, f"id long, text string, styled_text string, source_tags {tags}, target_tags {tags}")
    token = "array<struct<start:int,end:int,tag:string>>"
    df = df.withColumn("edges", F.array().cast(G.EDGES)).withColumn("source_gender", G.gender_maps("text", F.array().cast(token))).withColumn("target_gender", G.gender_maps("styled_text", F.array().cast(token)))
    got = G.gender_scores(df, source_text="text", target_text="styled_text").collect()
    assert all(r["gender_score"] == 1.0 and not r["gender_activated"] and not r["has_switch"] for r in got)


def test_removed_spans_leave_the_other_words():
    """Kept words stay in order; what goes is a head or a tail of a sentence, and nothing else changes but marks and one capital."""
    rng = random.Random(3)
    for _ in range(300):
        words = [rng.choice(["дом", "кот,", "лес", "— пёс", "сад;", "снег."]) for _ in range(rng.randrange(1, 14))]
        text = " ".join(words)
        scores = [rng.choice([0.0, 0.3, 0.9]) for _ in text.split()]
        for strategy in ("greedy_density", "longest_above_thr"):
            out = Z.remove_spans(text, scores, strategy=strategy)
            kept = iter(text.lower().split())
            assert all(any(w.strip(",;.—") in k for k in kept) for w in out.lower().replace("—", " ").split())
            assert out == text or len(out) < len(text) or not Z.removed_spans(text, scores, strategy=strategy)
    assert Z.remove_spans("Утром снег. Кот спит.", [1, 1, 0, 0]) == "Кот спит."


def test_generation_config():
    config = GenerationConfig.of(max_input_length=8, max_output_length=16, model_type="GPT", preset="v2")
    assert config.options() == {"num_beams": 4, "early_stopping": True, "max_new_tokens": 16, "min_new_tokens": 32, "num_return_sequences": 1}
    assert GenerationConfig.of(max_input_length=8, max_output_length=16).lengths() == {"max_length": 16, "min_length": 32}
    for wrong in ({"max_length": 5}, {"max_input_length": 5}, {"max_input_length": 5, "max_output_length": 5, "preset": "v9"}, {"max_input_length": 5, "max_output_length": 5, "norm": "odd"}):
        with pytest.raises(ValueError):
            GenerationConfig.of(**wrong)


def test_versions_run_the_generator_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def generate(texts):
        calls.add(len(texts))
        return [[t + "1", t + "2"] for t in texts]

    df = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "example_number long, text string")
    model = ByBatch(lambda: generate, ["text"], "versions", "array<string>")
    for expected in (None, 2):
        before = calls.value
        assert R.expand_versions(model(df), "versions", expected=expected).count() == 20
        assert calls.value - before == (10 if expected is None else 10)
    with pytest.raises(Exception, match="different lengths"):
        R.expand_versions(model(df), "versions", expected=3).collect()


def test_too_many_styles(spark, monkeypatch):
    monkeypatch.setattr(R, "MOST_STYLES", 1)
    df = spark.createDataFrame([(1, "x")], "id long, author string")
    with pytest.raises(ValueError, match="target styles"):
        R.other_styles(df, spark.createDataFrame([("x",), ("y",)], "style string"))


def test_translation_runs_once_a_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a", None])], "id long, text string")
    out = via_translation(lambda d: d.withColumn("translated", F.lower("text")), lambda d: d.withColumn("styled_text", F.upper("translated")))(df)
    assert sorted((r["id"], r["styled_text"]) for r in out.collect()) == [(0, "A"), (1, "B"), (2, "A"), (3, None)]


@pytest.mark.parametrize("picks", [1, 2, 3])
def test_even_draws(spark, picks):
    pool = spark.createDataFrame([(k, [float(i + 1), 1.0]) for k in "abcd" for i in range(4)], "author string, text_style_emb array<double>")
    rows = [(i, "abcde"[i % 5] if i % 7 else None, [3.0, 4.0]) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, author string, text_style_emb array<double>")
    got = P.draw_targets(df, pool, "author", "id", picks).collect()
    counts = {}
    for r in got:
        assert len(set(r["target_keys"])) == picks and r["author"] not in r["target_keys"]
        for k in r["target_keys"]:
            counts[k] = counts.get(k, 0) + 1
    assert len(got) == 2000 and max(counts.values()) < 1.15 * min(counts.values())


def test_draws_from_poor_pools(spark):
    one = spark.createDataFrame([("a", [1.0, 0.0])], "author string, text_style_emb array<double>")
    df = spark.createDataFrame([(1, "a", [3.0, 4.0]), (2, "b", [3.0, 4.0])], "id long, author string, text_style_emb array<double>")
    assert [r["target_keys"] for r in P.draw_targets(df, one, "author", "id", 2).collect()] == [["a", "a"], ["a", "a"]]
    empty = P.draw_targets(df, one.limit(0), "author", "id", 1).collect()
    assert [r["target_keys"] for r in empty] == [None, None] and [r["target_style_emb"] for r in empty] == [None, None]
    assert P.draw_targets(df.limit(0), one, "author", "id", 1).collect() == []


def test_compaction_goes_by_size(spark, tmp_path, monkeypatch):
    columns = {c: F.lit(0.5) for c in sink.REQUIRED if c not in ("styled_text", "styled_text_style_emb", "target_keys")}
    df = spark.range(300).select(F.col("id").alias("example_number"), F.sha2(F.col("id").cast("string"), 512).alias("styled_text"), F.array(F.lit(1.0)).alias("styled_text_style_emb"), F.array(F.lit("k")).alias("target_keys")).withColumns(columns)
    for k in range(2):
        sink.save_results(df.filter(F.col("example_number") % 2 == k), str(tmp_path / "store"))
    monkeypatch.setattr(sink, "FILE_BYTES", 8_000)
    whole = sink.compact(spark, str(tmp_path / "store"))
    assert whole.count() == 300 and len(sink.parts(spark, str(tmp_path / "store"))) == 1
    ranges = whole.groupBy(F.input_file_name().alias("f")).agg(F.min("example_number").alias("a"), F.max("example_number").alias("b")).orderBy("a").collect()
    assert len(ranges) > 1 and all(x["b"] < y["a"] for x, y in zip(ranges, ranges[1:]))


def test_running_shares(spark):
    df = spark.createDataFrame([([1, 1, 2],), ([5],), ([],), (None,), ([0, 0],)], "c array<int>")
    assert [r[0] for r in df.select(X.running_shares("c")).collect()] == [[0.25, 0.5], [], [], None, [None]]


def test_numbers_of_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(P, "NUMBERED", 10)
    pool = spark.createDataFrame([("hot" if i % 3 else f"k{i}", [float(i), 1.0]) for i in range(300)], "author string, text_style_emb array<double>")
    indexed, keys = P.pool_index(pool, "author", "text_style_emb")
    hot = sorted(r["_ordinal"] for r in indexed.filter("_key = 'hot'").collect())
    assert hot == list(range(200)) and sorted(r["_at"] for r in keys.collect()) == list(range(101))


def test_best_removals_equal_the_single_ones(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["дом", "кот,", "лес", "— пёс", "сад;", "снег."]) for _ in range(12)) for _ in range(30)] + ["", None]
    rows = [(i, "дом кот", t, [rng.choice([0.0, 0.3, 0.9]) for _ in (t or "").split()]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, styled_text string, scores array<double>")
    cost = lambda s, t: (len(t) % 7 / 7, [len(t) % 3 / 3])

    def rescore(pairs):
        n = F.length("candidate")
        return pairs.withColumn("bi_score", n % 7 / 7).withColumn("cl_word_scores", F.array(n % 3 / 3))

    got = {r["id"]: r["cleaned_text"] for r in Z.best_removals(df, "id", "text", "styled_text", "scores", rescore).collect()}
    assert got == {i: None if t is None else Z.best_removal(s, t, scores, cost) for i, s, t, scores in rows}


def test_readable_and_training_frame(spark):
    from tonewright.operators import segment as C

    df = spark.createDataFrame([("a b c", "d", [1.0]), ("", None, None)], "source string, target string, target_style_emb array<double>")
    lengths = lambda c: F.transform(X.words(c), F.length)
    t5, gpt = (C.training_frame(df, lengths, m, 4, 9).collect() for m in ("T5", "GPT"))
    assert t5[0].asDict() == {"style": [1.0], "input_ids": [1, 1, 1, 9], "attention_mask": [1] * 4, "labels": [1, 9]} and gpt[0]["input_ids"] == [1, 1, 1, 9]
    assert t5[1]["input_ids"] == [9] and t5[1]["labels"] is None and gpt[1]["input_ids"] is None
    ids = spark.createDataFrame([([72, -100, 105],), (None,)], "ids array<int>")
    assert [r[0] for r in ids.select(C.readable("ids", lambda x: bytes(x).decode())).collect()] == ["Hi", None]
    with pytest.raises(ValueError):
        C.training_frame(df, lengths, "RNN", 4, 9)
