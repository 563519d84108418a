"""Cutting chapters into training chunks at sentence ends (survey P6-P11, P15, P16, R6, A6, X18).

Chapters are grouped by (author, title, chapter_pos); one group is one chapter of a book, whose size the book bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def place_cuts(chunks: Sequence[float], ends: Sequence[float]) -> list[int]:
    """Rising indices into ``ends``, one per chunk boundary, with the least sum of distances; the later index wins a tie.

    best[c] after row r is the least cost with the r-th boundary at or before c; one pass per boundary.
    """
    n, m = len(chunks), len(ends)
    if n > m:
        raise ValueError("more boundaries than sentence ends")
    ends = np.asarray(ends, dtype=float)
    before = np.zeros(m + 1)  # cost of the earlier boundaries using the first c ends
    choice = []
    for r, x in enumerate(chunks):
        cost = np.abs(ends - x) + before[:m]
        cost[:r] = np.inf
        now = np.full(m + 1, np.inf)
        at = np.full(m + 1, -1)
        best, where = np.inf, -1
        for c in range(m):
            if cost[c] <= best:
                best, where = cost[c], c
            now[c + 1], at[c + 1] = best, where
        choice.append(at)
        before = now
    out, limit = [], m
    for at in reversed(choice):
        out.append(int(at[limit]))
        limit = out[-1]
    return out[::-1]


def chunk_ranges(cuts: Sequence[int], n: int) -> list[tuple[int, int]]:
    """Ranges [start, end) over n sentences, cut behind each index."""
    edges = [0, *[c + 1 for c in cuts], n]
    return list(zip(edges, edges[1:]))


def segment(counts: Sequence[int], n_chunks: int, sampler, rng: np.random.Generator) -> list[tuple[int, int]]:
    """Ranges of sentences whose token shares follow ``n_chunks`` lengths drawn from the sampler."""
    lengths = np.cumsum(sampler.sample(rng, n_chunks))
    ends = np.cumsum(counts)
    if not len(counts) or ends[-1] == 0:
        return [(0, len(counts))]
    return chunk_ranges(place_cuts((lengths / lengths[-1])[:-1], (ends / ends[-1])[:-1]), len(counts))


def chunk_count(tokens: Column, mean: float, n_sentences: Column) -> Column:
    """min(max(1, tokens / mean rounded half to even), sentences)"""
    return F.least(F.greatest(F.lit(1), F.bround(tokens / F.lit(float(mean)), 0).cast("int")), n_sentences.cast("int"))


def segment_chapters(df: DataFrame, sampler, keys: Sequence[str] = ("author", "title", "chapter_pos"), order: Sequence[str] = ("sent_pos",), text: str = "text_ru", tokens: str | None = None, seed: int = 1991, n_epochs: int = 1) -> DataFrame:
    """``df`` plus n_chunks and chunk: chapters cut into chunks of sentences.

    Sentences are ordered by ``order``, then text; sentences with a null or empty text are left out. ``tokens`` is a
    column of token counts, words by default. The lengths of a chapter depend on the seed and its keys only. With several
    epochs every chapter comes once an epoch (column epoch), cut anew.
    """
    from tonewright.functions.text import words

    added = ("sent_no", "chunk", "n_chunks")
    rows = df.select(*[c for c in df.columns if c not in added]).filter(F.length(text) > 0)
    if n_epochs > 1:
        rows, keys = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1)))), (*keys, "epoch")
    count = F.col(tokens) if tokens else F.size(words(text))
    mean = float(sampler.mean())
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.IntegerType()) for c in added]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import xxhash

        pdf = pdf.sort_values([*order, text], kind="stable").reset_index(drop=True)
        name = "\x1f".join(str(pdf[k].iloc[0]) for k in keys)
        rng = np.random.default_rng([seed, xxhash.xxh3_64_intdigest(name)])
        counts = pdf.pop("_n").tolist()
        n = min(max(1, round(sum(counts) / mean)), len(pdf))
        chunk = np.zeros(len(pdf), dtype=np.int32)
        for i, (a, b) in enumerate(segment(counts, n, sampler, rng)):
            chunk[a:b] = i
        return pdf.assign(sent_no=np.arange(len(pdf), dtype=np.int32), chunk=chunk, n_chunks=np.int32(n))

    return rows.withColumn("_n", count.cast("long")).groupBy(*keys).applyInPandas(run, schema)


def assemble(segmented: DataFrame, sources: Sequence[str], keys: Sequence[str] = ("author", "title", "chapter_pos"), text: str = "text_ru", separator: str = " ", seed: int | None = None) -> DataFrame:
    """(keys, chunk, source, target, n_sentences): chunks with their sentences joined in order.

    A sentence's source is its first non-empty option, or one at random by hash when ``seed`` is given; sentences
    without an option add nothing to the source.
    """
    from tonewright.functions.vector import uniform
    from tonewright.operators.reshape import source_options

    options = source_options(sources)
    if seed is None:
        option = F.try_element_at(options, F.lit(1))
    else:
        option = F.get(options, F.floor(uniform(seed, *keys, "sent_no") * F.size(options)).cast("int"))
    rows = segmented.withColumn("_source", option["text"])
    lists = F.array_sort(F.collect_list(F.struct("sent_no", F.col("_source").alias("s"), F.col(text).alias("t"))))
    grouped = rows.groupBy(*keys, "chunk").agg(lists.alias("_l"))
    join = lambda f: F.array_join(F.filter(F.transform("_l", lambda x: x[f]), lambda x: x.isNotNull()), separator)
    return grouped.select(*keys, "chunk", join("s").alias("source"), join("t").alias("target"), F.size("_l").alias("n_sentences"))


def assemble_ids(
    segmented: DataFrame, sources: Sequence[str], target: str, model: str, most: int, eos: int, space: int | None = None, tag: Column | None = None,
    keys: Sequence[str] = ("author", "title", "chapter_pos"), seed: int | None = None,
) -> DataFrame:
    """(keys, chunk, input_ids, attention_mask, labels): training rows of chunks of sentences given as id arrays.

    ``sources`` are the columns of a sentence's options, the first non-empty one being taken, or one at random by hash with a
    ``seed``; a sentence without an option adds no ids to the source. GPT has the id ``space`` between sentences. Sides are cut as
    by ``pair_input``.
    """
    from tonewright.functions.vector import uniform

    options = F.filter(F.array(*[F.col(c) for c in sources]), lambda o: o.isNotNull() & (F.size(o) > 0))
    at = F.lit(0) if seed is None else F.floor(uniform(seed, *keys, "sent_no") * F.size(options)).cast("int")
    nothing = F.array().cast("array<int>")
    rows = segmented.select(*keys, "chunk", "sent_no", F.coalesce(F.get(options, at), nothing).cast("array<int>").alias("s"), F.coalesce(F.col(target), nothing).cast("array<int>").alias("t"))
    grouped = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(F.struct("sent_no", "s", "t"))).alias("_l"))  # the sentences of a chunk
    gap = F.array(F.lit(space).cast("int")) if model == "GPT" and space is not None else nothing

    def joined(side):
        return F.flatten(F.transform("_l", lambda x, i: F.concat(F.when(i > 0, gap).otherwise(nothing), x[side])))

    whole = grouped.select(*keys, "chunk", joined("s").alias("_s"), joined("t").alias("_t"))
    return whole.select(*keys, "chunk", *[c.alias(n) for n, c in pair_input("_s", "_t", model, most, eos, tag).items()])


def training_frame(
    df: DataFrame, tokenise: Callable[[Column], Column], model: str, most: int, eos: int, source: str = "source", target: str = "target", style: str = "target_style_emb",
) -> DataFrame:
    """(style, input_ids, attention_mask[, labels]): stored pairs as training rows; texts and other columns are left out.

    ``tokenise`` gives the ids of a text column. T5 cuts each side to ``most`` ids, its end mark among them. GPT has source, end
    mark, target and end mark in one sequence, cut to ``most`` in all.
    """
    s, t, end = tokenise(F.col(source)), tokenise(F.col(target)), F.array(F.lit(eos))
    if model == "T5":
        columns = {"input_ids": F.concat(F.slice(s, 1, most - 1), end), "labels": F.concat(F.slice(t, 1, most - 1), end)}
    elif model == "GPT":
        columns = {"input_ids": F.slice(F.concat(s, end, t, end), 1, most)}
    else:
        raise ValueError(f"unknown model type {model!r}")
    ids = df.select(F.col(style).alias("style"), *[c.alias(n) for n, c in columns.items()])
    mask = F.transform("input_ids", lambda _: F.lit(1)).alias("attention_mask")
    return ids.select("style", "input_ids", mask, *[n for n in columns if n != "input_ids"])


def readable(ids: str | Column, decode: Callable[[Sequence[int]], str]) -> Column:
    """Texts of id arrays for the eye, ids below 0 left out; null for null."""

    @F.pandas_udf("string")
    def run(lists: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode([int(i) for i in x if i >= 0]) for x in lists])

    return run(ids)


def pair_input(source: str, target: str, model: str, most: int, eos: int, tag: Column | None = None) -> dict[str, Column]:
    """input_ids, attention_mask and labels of a pair of id arrays, cut to ``most`` a side.

    T5: tag and source, target as labels, each to most - 1 plus the end mark. GPT: source, tag or end mark, target and
    end mark in one sequence, with -100 labels up to the target; sides keep at most most - 1 ids.
    """
    s, t = F.col(source), F.col(target)
    end = F.array(F.lit(eos))
    if model == "T5":
        s = F.concat(tag, s) if tag is not None else s
        ids = F.concat(F.slice(s, 1, most - 1), end)
        return {"input_ids": ids, "attention_mask": F.transform(ids, lambda _: F.lit(1)), "labels": F.concat(F.slice(t, 1, most - 1), end)}
    if model != "GPT":
        raise ValueError(f"unknown model type {model!r}")
    front = F.concat(F.slice(s, 1, most - 1), tag if tag is not None else end)
    back = F.concat(F.slice(t, 1, most - 1), end)
    ids = F.concat(front, back)
    return {"input_ids": ids, "attention_mask": F.transform(ids, lambda _: F.lit(1)), "labels": F.concat(F.transform(front, lambda _: F.lit(-100)), back)}


def padded(df: DataFrame, columns: dict[str, int], batch: str) -> DataFrame:
    """Arrays filled on the right with a value to the longest of their batch (``batch`` names a column of batch numbers)."""
    out = df
    for name, fill in columns.items():
        widest = df.groupBy(batch).agg(F.max(F.size(name)).alias("_most"))
        out = out.join(widest, batch).withColumn(name, F.concat(name, F.array_repeat(F.lit(fill), F.col("_most") - F.size(name)))).drop("_most")
    return out
