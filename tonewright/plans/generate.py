"""The generation plan: draw targets, generate, score, filter, store, retry (survey 3.2, 3.3)."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewright.functions.scores import nat_v2
from tonewright.functions.vector import sim_measure, uniform
from tonewright.operators.sampling import add_targets, with_target_kind
from tonewright.operators.select import keep_mask, near_target, unknown_ids
from tonewright.plans.evaluate import Evaluation
from tonewright.providers import Provider
from tonewright.session import checkpoint_dir, cut
from tonewright.sources.sink import compact, exists as _exists, read_results, save_results


@dataclass
class Generation:
    """Mass production of pairs from a base pool, resumable and with bounded attempts.

    A row's draws depend on (seed, id, attempt), so a retry gets another target whatever the partitioning.
    """

    base: DataFrame
    domain_pool: DataFrame
    author_pool: DataFrame
    generate: Provider
    quality: list
    folder: str
    source_features: list | None = None
    version_features: list | None = None
    seed: int = 1991
    target_norm: float | None = None
    source_domain: str | None = None
    rows_at_once: int = 30_000
    model: str = "generator"

    def paraphrases(self, rows: DataFrame) -> DataFrame:
        """Kept best versions of ``rows`` (with a column attempt)."""
        df = with_target_kind(rows, "domain", "example_number", self.seed, ("attempt",))
        df = add_targets(df, self.domain_pool, self.author_pool, "example_number", self.seed, self.target_norm, self.source_domain, ("attempt",))
        df = near_target(df.withColumn("target_style_sim_measure", sim_measure("text_style_emb", "target_style_emb")))
        options = {k: v for k, v in (("source_features", self.source_features), ("version_features", self.version_features)) if v is not None}
        best = Evaluation(df, self.generate, model=self.model, quality=self.quality, **options).best()
        best = best.withColumn("tst_result_style_sim", sim_measure("text_style_emb", "styled_text_style_emb"))
        best = best.withColumn("nat_v2", nat_v2("styled_text_perplexity", "text_perplexity", "target_style_desc"))
        return best.filter(keep_mask(best))

    def run(self, max_attempts: int = 3) -> DataFrame:
        """Process the queue to its end and return (example_number, attempts, status): done or abandoned.

        Rows already stored are done. The others are written once, in slices of about ``rows_at_once`` rows by hash. Every
        attempt goes through the slices; a slice takes the rows that no earlier attempt passed, and appends what became of
        them to its own part of the state. Nothing is written again, so the work grows with the rows.
        """
        spark = self.base.sparkSession
        done = compact(spark, self.folder)
        base = self.base
        if done is not None:
            base = base.join(done.select("example_number").distinct(), "example_number", "left_anti")
        work = f"{checkpoint_dir(spark)}/queue-{uuid.uuid4().hex}"
        slices = max(1, -(-base.count() // self.rows_at_once))
        cut_at = F.floor(uniform(self.seed, "example_number") * slices).cast("int")
        base.withColumn("_slice", cut_at).repartition("_slice").write.partitionBy("_slice").parquet(f"{work}/rows")
        stored = T.StructType([*base.schema.fields, T.StructField("_slice", T.IntegerType())])
        schema = "example_number long, attempts int, ok boolean, _slice int"
        told = lambda: spark.read.schema(schema).parquet(f"{work}/state") if _exists(spark, f"{work}/state") else spark.createDataFrame([], schema)
        for attempt in range(max_attempts):
            for number in range(slices):
                rows = spark.read.schema(stored).parquet(f"{work}/rows").filter(F.col("_slice") == number).drop("_slice")
                passed = told().filter((F.col("_slice") == number) & F.col("ok")).select("example_number")
                now = cut(rows.join(passed, "example_number", "left_anti").withColumn("attempt", F.lit(attempt)))
                if now.isEmpty():
                    continue
                kept = cut(self.paraphrases(now))
                if not unknown_ids(kept, now, "example_number").isEmpty():
                    raise ValueError("the generator returned unknown ids")
                save_results(kept, self.folder)
                ok = kept.select("example_number").distinct().withColumn("ok", F.lit(True))
                after = now.select("example_number").distinct().join(ok, "example_number", "left").select(
                    "example_number", F.lit(attempt + 1).alias("attempts"), F.coalesce("ok", F.lit(False)).alias("ok"), F.lit(number).alias("_slice")
                )
                after.write.mode("append").partitionBy("_slice").parquet(f"{work}/state")
        ended = told().groupBy("example_number").agg(F.max("attempts").alias("attempts"), F.max("ok").alias("ok"))
        return ended.select("example_number", "attempts", F.when(F.col("ok"), "done").otherwise("abandoned").alias("status"))

    def stored(self) -> DataFrame | None:
        return read_results(self.base.sparkSession, self.folder)
