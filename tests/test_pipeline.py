import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewright import providers as D
from tonewright.plans.evaluate import Evaluation, version_two_scores
from tonewright.plans.generate import Generation
from tonewright.sources import readers, sink

FEATURES = dict(text_perplexity=3.0, text_style_emb=[1.0, 0.0], text_labse_emb=[1.0])


def _sources(spark, n=3):
    rows = [(i, f"текст {i}", "a" if i else None, "x", 3.0, [1.0, 0.1 * i], [0.0, 1.0]) for i in range(n)]
    return spark.createDataFrame(rows, "example_number long, text string, author string, domain string, text_perplexity double, text_style_emb array<double>, target_style_emb array<double>")


def _generate(df):
    return df.withColumn("versions", F.array(F.concat("text", F.lit(" a")), F.concat("text", F.lit(" b"))))


def _features(df):
    better = F.col("styled_text").endswith("b")
    return (
        df.withColumn("styled_text_perplexity", F.lit(3.1)).withColumn("bert_score", F.when(better, 0.95).otherwise(0.9)).withColumn("labse_score", F.lit(0.95))
        .withColumn("styled_text_style_emb", F.when(better, F.array(F.lit(0.5), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(1.0))))
    )


VERSION = [(_features, ("styled_text_perplexity", "styled_text_style_emb", "bert_score", "labse_score"))]


def test_evaluation_picks_a_later_version(spark):
    e = Evaluation(_sources(spark), _generate, version_features=VERSION)
    best = e.best().collect()
    assert len(best) == 3 and {r["version_number"] for r in best} == {1} and all(0 < r["chrf"] < 1 for r in best)
    assert e.performance().first()["style_set"] == "DATA_MEAN"


def test_version_two_needs_columns(spark):
    with pytest.raises(KeyError, match="bi_score"):
        version_two_scores(_sources(spark))


def _quality(df):
    fine = F.col("example_number") != 2
    return df.select("*", F.lit(0.0).alias("bi_score"), F.lit(0.0).alias("cl_score"), F.lit(1.0).alias("gender_score"), F.lit(False).alias("gender_activated"), F.when(fine, 1.0).otherwise(0.0).alias("entity_score"))


def test_generation_retries_and_resumes(spark, tmp_path):
    pool = spark.createDataFrame([("b", "y", [0.0, 1.0]), ("c", "z", [0.1, 1.0]), ("d", "y", [0.0, 2.0])], "author string, domain string, text_style_emb array<double>")
    columns = ("bi_score", "cl_score", "gender_score", "gender_activated", "entity_score")
    base = _sources(spark).drop("target_style_emb")
    run = Generation(base, pool, pool, lambda df: df.withColumn("versions", F.array(F.lit("совсем."))), [(_quality, columns)], str(tmp_path / "out"), version_features=VERSION, rows_at_once=2)
    state = {r["example_number"]: (r["attempts"], r["status"]) for r in run.run(2).collect()}
    assert state == {0: (1, "done"), 1: (1, "done"), 2: (2, "abandoned")}
    assert sorted(r["example_number"] for r in run.stored().collect()) == [0, 1]
    again = {r["example_number"] for r in run.run(1).collect()}
    assert again == {2}


def test_sink_parts(spark, tmp_path):
    folder = str(tmp_path / "res")
    row = {c: 0.5 for c in sink.REQUIRED} | {"styled_text": "a", "styled_text_style_emb": [0.1, 0.2], "target_keys": ["k"], "example_number": 2}
    df = spark.createDataFrame([row])
    assert sink.save_results(df, folder) == "part_00001" and sink.save_results(df.withColumn("example_number", F.lit(1).cast("long")), folder) == "part_00002"
    assert sink.save_results(df.limit(0), folder) is None
    with pytest.raises(KeyError):
        sink.save_results(df.drop("chrf"), folder)
    merged = sink.compact(spark, folder)
    assert sink.parts(spark, folder) == ["part_00003"] and [r["example_number"] for r in merged.collect()] == [1, 2]
    assert merged.first()["styled_text_style_emb"][0] == pytest.approx(float(np.float16(0.1)))
    assert sink.remaining(spark.range(4).withColumnRenamed("id", "example_number"), spark, folder).count() == 2


def test_readers(spark, tmp_path):
    np.savez(tmp_path / "c.npz", a=np.array([3.0] * 50), meta=np.array([1.0, 2.0]), k=np.arange(60))
    rows = readers.read_centroids(spark, str(tmp_path / "c.npz"), renormalise=True).collect()
    assert [r["style"] for r in rows] == ["a"] and np.linalg.norm(rows[0]["centroid"]) == pytest.approx(1)
    (tmp_path / "n.csv").write_text('text_ru,text_ru_pph\n"a, ""b""",c\n')
    assert readers.read_news(spark, str(tmp_path / "n.csv")).first().asDict() == {"text_ru": 'a, "b"', "text_ru_pph": "c", "author": "News"}
    spark.range(5).write.parquet(str(tmp_path / "t"))
    df = readers.read_training(spark, [str(tmp_path / "t")] * 2, seed=0, n_epochs=2)
    assert df.count() == 20 and df.filter("file_no = 0").select("position_key").distinct().count() == 10


def test_providers(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "t string")
    calls = D.ByBatch(lambda: lambda xs: [len(x) for x in xs], ["t"], "n", "int", batch=2)
    assert [r["n"] for r in D.once(df, calls, "t", "n").collect()] == [1, 1, 1]
    with pytest.raises(KeyError):
        D.Precomputed("z")(df)
    with pytest.raises(ValueError):
        D.ByBatch(lambda: len, ["t"], "n", "int", t=1)
    assert D.ensure(df, D.Precomputed("z"), "t") is df


def test_stream(spark, tmp_path):
    from tonewright.streaming.scoring import score_stream

    spark.range(3).write.parquet(str(tmp_path / "in/part_00001"))
    args = (spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "cp"), lambda d: d.withColumn("x", F.col("id") * 2))
    score_stream(*args).awaitTermination(60)
    spark.range(3, 5).write.parquet(str(tmp_path / "in/part_00002"))
    score_stream(*args).awaitTermination(60)
    assert sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 2, 4, 6, 8]
