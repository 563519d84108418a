"""Interfaces to neural models (survey D1-D12). No model ships with the engine and none is imitated.

A provider adds columns to a frame. ``Precomputed`` trusts columns that are there; ``ByBatch`` wraps a callable on
batches, built once per Python worker; ``once`` computes a feature for distinct texts only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What each provider adds: name to columns and types.
CONTRACTS = {
    "perplexity": "ce double, n_tokens int",
    "style_embedding": "array<double>",
    "sentence_embedding": "array<double>",
    "bert_score": "double",
    "generation": "array<string>",
    "entities": "array<struct<entity_group:string,word:string,start:int,end:int>>",
    "morphology": "array<struct<word:string,tag:string,start:int,end:int>>",
    "alignment": "array<struct<i:int,j:int>>",
    "word_probabilities": "struct<bi:array<double>,cl:array<double>>",
    "token_ids": "array<int>",
    "translation": "string",
}
#: Generation presets.
PRESETS = {
    "v1": {"do_sample": True, "temperature": 0.8, "top_p": 0.95, "top_k": 50, "repetition_penalty": 1.0},
    "v2": {"num_beams": 4, "early_stopping": True},
    "v3": {"do_sample": True, "top_p": 0.8, "temperature": 1.0},
}
#: Options that have other names now, with these.
RENAMED = {"max_length": ("max_input_length", "max_output_length"), "min_length": ("min_output_length",)}


@dataclass(frozen=True)
class GenerationConfig:
    """Settings of a generator, checked when they are made.

    Both length budgets are needed: ids kept of the input, and ids generated. ``preset`` names one of PRESETS. The norm
    convention of style vectors is "normalized", "unnormalized" or None.
    """

    max_input_length: int
    max_output_length: int
    min_output_length: int = 32
    model_type: str = "T5"
    preset: str = "v1"
    batch_size: int = 8
    num_sequences: int = 1
    norm: str | None = None

    def __post_init__(self):
        from tonewright.functions.vector import norm_ok

        if self.model_type not in ("T5", "GPT"):
            raise ValueError(f"unknown model type {self.model_type!r}")
        if self.preset not in PRESETS:
            raise ValueError(f"unknown preset {self.preset!r}")
        if min(self.max_input_length, self.max_output_length, self.batch_size, self.num_sequences) < 1:
            raise ValueError("lengths, batches and numbers of sequences are at least 1")
        norm_ok("_", self.norm)

    @classmethod
    def of(cls, **options) -> GenerationConfig:
        """Settings from options; a renamed or missing one is an error that says what to give."""
        for old in RENAMED.keys() & options.keys():
            raise ValueError(f"{old} is now {' and '.join(RENAMED[old])}")
        missing = {"max_input_length", "max_output_length"} - options.keys()
        if missing:
            raise ValueError(f"needed: {', '.join(sorted(missing))}")
        return cls(**options)

    def lengths(self) -> dict[str, int]:
        """The options of a model's own generation that hold the output to its budget."""
        names = ("max_new_tokens", "min_new_tokens") if self.model_type == "GPT" else ("max_length", "min_length")
        return dict(zip(names, (self.max_output_length, self.min_output_length)))

    def options(self) -> dict[str, Any]:
        return PRESETS[self.preset] | self.lengths() | {"num_return_sequences": self.num_sequences}

    def model_input(self, ids: str | Column, tag: Column) -> Column:
        """Input ids: T5 has the tag in front and cuts all to the budget, GPT cuts the text and then has the tag behind."""
        c = F.col(ids) if isinstance(ids, str) else ids
        if self.model_type == "T5":
            return F.slice(F.concat(tag, c), 1, self.max_input_length)
        return F.concat(F.slice(c, 1, self.max_input_length), tag)


class Provider(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


class Precomputed:
    """Columns that the frame already holds; an error names those it lacks."""

    def __init__(self, *columns: str):
        self.columns = columns

    def __call__(self, df: DataFrame) -> DataFrame:
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise KeyError(f"no provider and no stored columns for {missing}")
        return df


class ByBatch:
    """A model behind a callable: ``build()`` runs once per worker and gives a function from lists to a list of results.

    Inputs are batched by Arrow and in lists of ``batch`` rows. A result list of another length is an error. Keyword
    arguments that repeat the inputs are an error.
    """

    def __init__(self, build: Callable[[], Callable[..., Sequence[Any]]], inputs: Sequence[str], output: str, kind: str, batch: int = 64, **options: Any):
        clash = set(inputs) & set(options)
        if clash:
            raise ValueError(f"options repeat inputs: {sorted(clash)}")
        self.build, self.inputs, self.output, self.kind, self.batch, self.options = build, list(inputs), output, kind, batch, options

    def __call__(self, df: DataFrame) -> DataFrame:
        build, batch, options, n_inputs = self.build, self.batch, self.options, len(self.inputs)

        def run(frames: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = build()
            for columns in frames:
                out: list[Any] = []
                for at in range(0, len(columns[0]), batch):
                    part = [c.iloc[at : at + batch].tolist() for c in columns[:n_inputs]]
                    got = list(model(*part, **options))
                    if len(got) != len(part[0]):
                        raise ValueError(f"the model gave {len(got)} results for {len(part[0])} rows")
                    out += got
                yield pd.Series(out)

        if n_inputs == 1:
            def single(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
                yield from run((f,) for f in frames)

            single.__annotations__ = {"frames": Iterator[pd.Series], "return": Iterator[pd.Series]}
            udf = F.pandas_udf(single, self.kind)
        else:
            run.__annotations__ = {"frames": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
            udf = F.pandas_udf(run, self.kind)
        return df.withColumn(self.output, udf(*self.inputs))


def ensure(df: DataFrame, provider: Provider, *columns: str) -> DataFrame:
    """The provider's columns, unless the frame has them all; stored values are trusted as they are."""
    return df if all(c in df.columns for c in columns) else provider(df)


def once(df: DataFrame, provider: Provider, key: str, *columns: str) -> DataFrame:
    """The provider run on the distinct values of ``key``, its columns joined back."""
    distinct = provider(df.select(key).filter(F.col(key).isNotNull()).distinct()).select(key, *columns)
    return df.join(distinct, key, "left")


def source_caches(df: DataFrame, perplexity: Provider, style: Provider, sentence: Provider) -> DataFrame:
    """text_perplexity, text_style_emb and text_labse_emb, each computed only where the frame lacks it."""
    for provider, column in ((perplexity, "text_perplexity"), (style, "text_style_emb"), (sentence, "text_labse_emb")):
        df = ensure(df, provider, column)
    return df


def corpus_cross_entropy(df: DataFrame, ce: str = "ce", tokens: str = "n_tokens", *by: str) -> DataFrame:
    """Mean cross-entropy of a corpus, by tokens."""
    from tonewright.functions.scores import weighted_mean

    return df.groupBy(*by).agg(weighted_mean(ce, tokens).alias("corpus_ce"))


def via_translation(there: Provider, back: Provider, text: str = "text", between: str = "translated", out: str = "styled_text") -> Provider:
    """Style transfer by translating to another language and back.

    ``there`` adds ``between`` to a frame with ``text``, ``back`` adds ``out`` to one with ``between``. Each distinct text goes there
    and each distinct translation comes back once.
    """
    return lambda df: once(once(df, there, text, between), back, between, out)
