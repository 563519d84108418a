import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright.functions import scores as S
from tonewright.functions import text as X
from tonewright.functions import vector as V
from tonewright.functions.strings import best_string_sim, chrf, string_sim


def one(spark, *columns, row=None, schema=None):
    df = spark.createDataFrame([row], schema) if row is not None else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_vectors_against_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *(rng.normal(size=8).tolist() for _ in range(3))) for i in range(30)]
    df = spark.createDataFrame(rows, "id long, s array<double>, c array<double>, t array<double>")
    got = df.select("id", V.sim_measure("s", "t").alias("sim"), V.away("s", "c", "t").alias("away"), V.towards("s", "c", "t").alias("towards")).collect()

    def sim(u, v):
        c = np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)
        return (1 + (1 - math.acos(max(-1, min(1, c))) / math.pi)) / 2

    for r in got:
        _, s, c, t = rows[r["id"]]
        d = 1 - sim(t, s)
        assert r["sim"] == pytest.approx(sim(s, t))
        assert r["away"] == pytest.approx(min(1 - sim(c, s), d) / d)
        assert r["towards"] == pytest.approx(max(sim(c, t) - sim(s, t), 0) / d)


def test_vector_traps(spark):
    row = ([1.0, 0.0], [0.0, 0.0], None)
    r = one(spark, V.away("a", "a", "a"), V.sim_measure("a", "z"), V.sim_measure("a", "n"), V.normalised("z"), row=row, schema="a array<double>, z array<double>, n array<double>")
    assert r["c0"] is None and r["c1"] is None and r["c2"] is None and r["c3"] == [None, None]


def test_rescale_and_noise(spark):
    schema = "s array<double>, t array<double>, z array<double>"
    r = one(spark, V.norm(V.rescaled("t", "s")), V.norm(V.rescaled("t", "z")), V.rescaled("z", "s"), V.norm(V.rescaled("t", None, 1.0)),
            V.norm(V.noisy("t", 0.01, 1, F.lit("k"))), V.negated("t", 1.0, 1), V.negated("t", 0.0, 1), row=([3.0, 4.0], [6.0, 8.0], [0.0, 0.0]), schema=schema)
    assert r["c0"] == pytest.approx(5) and r["c1"] == pytest.approx(1) and r["c2"] == [0, 0] and r["c3"] == pytest.approx(1)
    assert r["c4"] == pytest.approx(10) and r["c5"] == [-6, -8] and r["c6"] == [6, 8]


def test_norm_guard(spark):
    df = spark.createDataFrame([([0.6, 0.8],), ([9.0, 12.0],)], "v array<double>")
    assert [r[0] for r in df.select(V.norm_ok("v", "normalized")).collect()] == [True, False]
    assert [r[0] for r in df.select(V.norm_ok("v", "unnormalized")).collect()] == [False, True]
    with pytest.raises(Exception, match="not normalized"):
        df.select(V.guarded("v", "normalized")).collect()
    with pytest.raises(ValueError):
        V.guarded("v", "unnormalized", auto_normalise=True)


def test_composite_varies_with_every_part(spark):
    def score(style=0.5, meaning=0.7, bicl=0.8, gender=0.6, entity=0.4):
        return one(spark, S.base_score_v2(*map(F.lit, (style, meaning, bicl, gender, entity))))["c0"]

    g, e = 0.1 + 0.9 * 0.6, 0.1 + 0.9 * 0.4
    meaning = (0.7**0.5 * 0.8**0.5 * g * e**0.5) ** (1 / 2.5)
    assert score() == pytest.approx((0.5 * meaning**2.5) ** (1 / 3.5))
    assert len({round(score(**{k: 0.3}), 9) for k in ("style", "meaning", "bicl", "gender", "entity")} | {round(score(), 9)}) == 6


def test_nat_v2_reference(spark):
    cases = [(4.0, 3.0, None, 1 / 1.3), (4.5, 3.0, "Gogol", 1.0), (5.0, 4.9, "Gogol", 1.0), (4.5, 3.0, "news", 1 / (4.5 - 3.151731 - 0.7 + 1)), (4.0, 3.0, "?", 1 / 1.3)]
    df = spark.createDataFrame([c[:3] for c in cases], "t double, s double, n string")
    for r, c in zip(df.select(S.nat_v2("t", "s", "n").alias("v")).collect(), cases):
        assert r["v"] == pytest.approx(c[3])


def test_clip_keeps_nan_and_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (2.0,), (-1.0,)], "x double")
    a, b, c, d = (r[0] for r in df.select(S.clip("x", 0.0, 1.0)).collect())
    assert math.isnan(a) and b is None and c == 1 and d == 0


def test_length_ratio(spark):
    df = spark.createDataFrame([("", ""), ("ab", "abcd"), ("я", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(S.length_ratio("a", "b")).collect()] == [0.0, 0.5, 0.0, None]


def test_domain_weights(spark):
    rows = S.domain_weights(S.domain_similarity(spark)).collect()
    w = {r["target"]: r["weight"] for r in rows if r["source"] == "news"}
    assert len(rows) == 72
    assert sum(w.values()) == pytest.approx(1) and min(w, key=w.get) == "wikipedia" and w["Bible"] == pytest.approx(w["writers"])
    assert len(S.target_styles("writers")) == 12 and len(S.target_styles("news")) == 6


def test_words(spark):
    df = spark.createDataFrame([("  Он\xa0сказал: «да!» —\nи ушёл…",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(X.clean_words("t")).collect()]
    assert got == [["Он", "сказал", "да", "—", "и", "ушёл"], [], None]


def test_density_against_convolution(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(2) for _ in range(rng.randrange(0, 25))],) for _ in range(40)]
    df = spark.createDataFrame(rows, "f array<int>")
    for window in (3, 4, 9, 15):
        for r in df.select("f", X.density("f", window).alias("d")).collect():
            n = len(r["f"])
            if not n:
                assert r["d"] == []
                continue
            kernel = np.ones(window)
            want = np.convolve(r["f"], kernel, mode="same") / np.convolve(np.ones(n), kernel, mode="same")
            assert r["d"] == pytest.approx(want[:n].tolist())


def test_span_score(spark):
    df = spark.createDataFrame([([1, 1, 1, 1, 0, 1, 1],), ([0, 0],), ([],)], "f array<int>")
    assert [round(r[0], 6) for r in df.select(X.span_score("f", 4)).collect()] == [round(4 / 7, 6), 0, 0]
    assert [round(r[0], 6) for r in df.select(X.span_score("f", 1)).collect()] == [round(6 / 7, 6), 0, 0]
    assert df.select(X.running_shares("f")).first()[0] == pytest.approx([1 / 6, 2 / 6, 3 / 6, 4 / 6, 4 / 6, 5 / 6])


def test_tags_and_decoding(spark):
    r = one(spark, X.author_tag("a"), X.tag_style(F.lit("<ilf and petrov>")), X.decoded("o", F.lit("<x>"), "</s>"), X.decoded(F.lit(" plain  "), F.lit("<x>"), "</s>"),
            row=("Ilf and Petrov", "in <x> out </s> rest"), schema="a string, o string")
    assert list(r) == ["<ilf_and_petrov>", "Ilf and petrov", "out", "plain"]


def test_string_similarities():
    assert chrf("abc", "abc") == pytest.approx(1) and chrf("", "") == 0 and chrf(None, "a") is None and chrf("abc", "xyz") == 0
    assert chrf("кот спит", "кот спит тут") < 1 and string_sim("Иван", "ивану") == pytest.approx(8 / 9)
    assert best_string_sim("Иван", []) == 0
