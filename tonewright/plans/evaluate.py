"""The evaluation plan: sources to scored versions, the best version of each group, and final figures (survey 3.1).

One lazy frame; models are nodes of it. The only shuffle of the relational part is the choice of the best version.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.functions import scores as S
from tonewright.functions import vector as V
from tonewright.functions.strings import chrf_score
from tonewright.operators.reshape import expand_versions, other_styles, single_version
from tonewright.operators.select import best_version, final_performance, with_centroids
from tonewright.providers import Precomputed, Provider, ensure


def version_one_scores(df: DataFrame) -> DataFrame:
    """away, towards, style_score, meaning_score, naturality_score and score from vectors, similarities and
    cross-entropies; the target is ``target_style_emb`` or else ``centroid``."""
    target = "target_style_emb" if "target_style_emb" in df.columns else "centroid"
    source, current = "text_style_emb", "styled_text_style_emb"
    out = df.withColumn("away", V.away(source, current, target)).withColumn("towards", V.towards(source, current, target))
    out = out.withColumn("style_score", S.style_score("away", "towards"))
    out = out.withColumn("meaning_score", S.meaning_score("bert_score", "labse_score", S.length_penalty("text", "styled_text")))
    out = out.withColumn("naturality_score", S.naturality_score("text_perplexity", "styled_text_perplexity"))
    return out.withColumn("score", S.combined_score("style_score", "meaning_score", "naturality_score"))


def version_two_scores(df: DataFrame, margin: float = S.NAT_MARGIN, floor: float = S.FLOOR) -> DataFrame:
    """bi_cl where absent, meaning_nolen, nat_v2 and score_v2. Needed columns that are missing are an error."""
    needed = ["style_score", "bert_score", "labse_score", "text_perplexity", "styled_text_perplexity", "gender_score", "entity_score"]
    if "bi_cl" not in df.columns:
        needed += ["bi_score", "cl_score"]
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError(f"columns missing for score_v2: {missing}")
    style = next((c for c in ("target_style", "target_style_desc") if c in df.columns), None)
    out = df if "bi_cl" in df.columns else df.withColumn("bi_cl", S.bi_cl("bi_score", "cl_score"))
    out = out.withColumn("meaning_nolen", S.meaning_score("bert_score", "labse_score"))
    out = out.withColumn("nat_v2", S.nat_v2("styled_text_perplexity", "text_perplexity", style, margin))
    base = S.base_score_v2("style_score", "meaning_nolen", "bi_cl", "gender_score", "entity_score", floor)
    return out.withColumn("score_v2", base * F.col("nat_v2"))


@dataclass
class Evaluation:
    """An evaluation of style transfer. Providers default to stored columns."""

    sources: DataFrame
    generate: Provider | None = None
    styles: DataFrame | None = None
    model: str = "model"
    source_features: Sequence[tuple[Provider, tuple[str, ...]]] = field(default_factory=lambda: [(Precomputed("text_perplexity", "text_style_emb"), ("text_perplexity", "text_style_emb"))])
    version_features: Sequence[tuple[Provider, tuple[str, ...]]] = field(default_factory=lambda: [(Precomputed("styled_text_perplexity", "styled_text_style_emb", "bert_score", "labse_score"), ("styled_text_perplexity", "styled_text_style_emb", "bert_score", "labse_score"))])
    quality: Sequence[tuple[Provider, tuple[str, ...]]] = ()

    def results(self) -> DataFrame:
        """One row per source, style and version, with features."""
        df = self.sources
        for provider, columns in self.source_features:
            df = ensure(df, provider, *columns)
        if self.styles is not None:
            df = with_centroids(other_styles(df, self.styles), self.styles, checked=False)
            df = df.withColumn("target_style_emb", F.col("centroid").cast("array<double>")).drop("centroid")
        elif "target_style_emb" not in df.columns and "styled_text" not in df.columns:
            raise ValueError("give target styles or a column target_style_emb")
        df = df.withColumn("tst_model", F.lit(self.model)) if "tst_model" not in df.columns else df
        if self.generate is not None:
            df = self.generate(df)
        if "versions" in df.columns:
            df = expand_versions(df, "versions")
        elif "version_number" not in df.columns:
            df = single_version(df)
        for provider, columns in self.version_features:
            df = ensure(df, provider, *columns)
        return df

    def scored(self) -> DataFrame:
        """All versions with version-one scores, and version-two scores where quality scores are there."""
        df = version_one_scores(self.results())
        for provider, columns in self.quality:
            df = ensure(df, provider, *columns)
        quality = {"gender_score", "entity_score"} <= set(df.columns) and ("bi_cl" in df.columns or {"bi_score", "cl_score"} <= set(df.columns))
        return version_two_scores(df) if quality else df

    def best(self, score: str = "score") -> DataFrame:
        """The best version of each group, with its copying score."""
        df = self.scored()
        keys = ["example_number"] + [c for c in ("target_style",) if c in df.columns]
        best = best_version(df, score, keys)
        return best.withColumn("chrf", chrf_score("styled_text", "text"))

    def performance(self, score: str = "score", sets=None) -> DataFrame:
        best = self.best(score)
        if "target_style" not in best.columns:
            return final_performance(best, score, sets={})
        return final_performance(best, score) if sets is None else final_performance(best, score, sets)
