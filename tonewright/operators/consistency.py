"""Alignment, entity and gender consistency given the outputs of models (survey G1-G20).

Edges, tags and entities come from providers (see ``providers``) or stored columns. Everything after them is a
column expression, except greedy parsing and string matching, which are Arrow-batched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewright.functions.strings import best_string_sim
from tonewright.functions.text import density, flags, peak_density, span_score, words
from tonewright.functions.vector import let

BI_ROLLING, BI_SPAN, CL_LIMIT = 0.75, 0.25, 0.25
EDGES = "array<struct<i:int,j:int>>"
ENTITIES = "map<string,array<string>>"
#: Entity types in use.
PERSONS, PLACES = ("FIRST_NAME", "LAST_NAME", "MIDDLE_NAME"), ("CITY", "REGION", "COUNTRY")
SAME_NAME = 0.75


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def unaligned(text: str, edges: str, side: str, most: int | None = None) -> Column:
    """Array of (idx, word) of the words without an edge; ``side`` is i (source) or j (target)."""
    pairs = F.transform(words(text, most), lambda w, i: F.struct(i.alias("idx"), w.alias("word")))
    hit = F.transform(F.col(edges), lambda e: e[side])
    return let(hit, lambda h: F.filter(pairs, lambda p: ~F.array_contains(h, p["idx"])))


def alignment_scores(
    df: DataFrame, source: str = "text", target: str = "styled_text", edges: str = "edges", score: str = "rolling_max", window: int = 9,
    min_span: int = 4, bi_limit: float | None = None, cl_limit: float = CL_LIMIT, most: int | None = None,
) -> DataFrame:
    """``df`` plus bi_score, cl_score, has_bi, has_cl, bi_word_mask, cl_word_mask.

    Both scores use the same function: peak density ("rolling_max") or share of long runs ("span"). An empty side
    scores 0 with empty masks; null edges are none (unhandled).
    """
    if score not in ("rolling_max", "span"):
        raise ValueError(f"unknown score {score!r}")
    limit = bi_limit if bi_limit is not None else BI_ROLLING if score == "rolling_max" else BI_SPAN
    df = df.withColumn("_edges", F.coalesce(F.col(edges), F.array().cast(EDGES)))
    out = df
    empty = (F.size(words(source, most)) == 0) | (F.size(words(target, most)) == 0)
    for name, text, side in (("bi", target, "j"), ("cl", source, "i")):
        mask = F.when(empty, F.array().cast("array<struct<idx:int,word:string>>")).otherwise(unaligned(text, "_edges", side, most))
        out = out.withColumn(f"{name}_word_mask", mask)
        f = flags(F.size(words(text, most)), F.transform(F.col(f"{name}_word_mask"), lambda p: p["idx"]))
        value = peak_density(f, window) if score == "rolling_max" else span_score(f, min_span)
        out = out.withColumn(f"{name}_score", F.when(empty, 0.0).otherwise(value))
    return out.withColumn("has_bi", F.col("bi_score") >= limit).withColumn("has_cl", F.col("cl_score") >= cl_limit).drop("_edges")


def blank_text(text: str) -> Column:
    """Whether a text is missing or has no word."""
    return F.coalesce(F.size(words(text)) == 0, F.lit(True))


def score_pairs(
    df: DataFrame, source: str, target: str, align, fallback=None, over: Column | None = None, **options,
) -> DataFrame:
    """``df`` plus edges and alignment scores, from_fallback and unhandled: the whole-pair scorer.

    ``align`` and ``fallback`` add ``edges`` to a frame of distinct (source, target) pairs, so that equal pairs are aligned once;
    pairs ``over`` the budget go to ``fallback``, or are unhandled without one. A null text has no words.
    """
    pairs = df.select(source, target).distinct()
    scored = lambda aligner: lambda rows: alignment_scores(aligner(rows), source, target, **options)
    plain = lambda rows: alignment_scores(rows, source, target, **options)
    done = routed(pairs, F.lit(False) if over is None else over, lambda rows: plain(rows) if "edges" in rows.columns else scored(align)(rows), None if fallback is None else scored(fallback))
    same = df[source].eqNullSafe(done[source]) & df[target].eqNullSafe(done[target])
    return df.join(done, same, "left").drop(done[source]).drop(done[target])


def once_per_source(df: DataFrame, source: str, compute, out: str) -> DataFrame:
    """A feature of the source computed once for its distinct values and joined back."""
    from tonewright.operators.select import memoised

    return memoised(df, source, compute, out)


def routed(df: DataFrame, over: Column, primary, fallback=None) -> DataFrame:
    """Rows within the budget through ``primary``, the others through ``fallback``; without one they are unhandled.

    Adds from_fallback and unhandled.
    """
    over = F.coalesce(over, F.lit(False))
    near = primary(df.filter(~over)).withColumn("from_fallback", F.lit(False)).withColumn("unhandled", F.lit(False))
    far = df.filter(over)
    far = primary(far.withColumn("edges", F.lit(None).cast(EDGES))) if fallback is None else fallback(far)
    far = far.withColumn("from_fallback", F.lit(fallback is not None)).withColumn("unhandled", F.lit(fallback is None))
    return near.unionByName(far)


def budget(max_positions: int, kind: str) -> int:
    """Sub-words an encoder holds: its positions without special tokens."""
    return max_positions - (4 if kind == "roberta" else 2)


def itermax(similarity: np.ndarray, rounds: int = 2, alpha: float = 0.9) -> list[tuple[int, int]]:
    """Edges by mutual best matches, repeated on what earlier rounds left: a pair with one aligned side counts
    ``alpha``, one with both sides nothing."""
    m, n = similarity.shape
    edges = np.zeros((m, n), dtype=bool)
    weight = np.ones((m, n))
    for k in range(rounds):
        if k:
            rows, cols = edges.any(1), edges.any(0)
            if rows.all() or cols.all():
                break
            free = ~rows[:, None] & ~cols[None, :]
            weight = np.where(free, 1.0, np.where(rows[:, None] & cols[None, :], 0.0, alpha))
        s = similarity * weight
        mutual = np.zeros_like(edges)
        best = s.argmax(1)
        back = s.argmax(0)
        for i, j in enumerate(best):
            if back[j] == i and s[i, j] > 0:
                mutual[i, j] = True
        if not (mutual & ~edges).any():
            break
        edges |= mutual
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(edges))]


@F.pandas_udf(T.ArrayType(_struct(i=T.IntegerType(), j=T.IntegerType())))
def itermax_edges(source: pd.Series, target: pd.Series) -> pd.Series:
    """Column of ``itermax`` from the word vectors of both sides (array<array<double>>); no edges where a side has none."""
    def one(s, t):
        if s is None or t is None or not len(s) or not len(t):
            return []
        a, b = (np.stack([np.asarray(v, dtype=float) for v in x]) for x in (s, t))
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (a, b))
        return [{"i": i, "j": j} for i, j in itermax((a @ b.T + 1) / 2)]

    return pd.Series([one(s, t) for s, t in zip(source, target)])


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def mean_vectors(subwords: pd.Series, owner: pd.Series) -> pd.Series:
    """Column of ``word_vectors`` from sub-word vectors and the word of each."""
    return pd.Series([None if s is None else word_vectors(np.stack([np.asarray(v, dtype=float) for v in s]), o).tolist() if len(s) else [] for s, o in zip(subwords, owner)])


def word_vectors(subwords: np.ndarray, owner: Sequence[int]) -> np.ndarray:
    """Mean sub-word vector of each word."""
    owner = np.asarray(owner)
    return np.stack([subwords[owner == w].mean(0) for w in range(owner.max() + 1)]) if len(owner) else np.zeros((0, subwords.shape[1]))


def word_probabilities(probabilities: str | Column, owner: str | Column, n_words: Column) -> Column:
    """The probability of each word, that of its first sub-word; 0 for words beyond what the classifier read.

    ``owner`` is the word of each sub-word.
    """
    def each(x):
        def chance(w):
            at = F.array_position(x["o"], w).cast("int")
            return F.when(at > 0, F.coalesce(F.get(x["p"], at - 1), F.lit(0.0))).otherwise(0.0)

        return F.when(x["n"] > 0, F.transform(F.sequence(F.lit(0), x["n"] - 1), chance)).otherwise(F.array().cast("array<double>"))

    p, o = (F.col(c) if isinstance(c, str) else c for c in (probabilities, owner))
    return let(F.struct(p.alias("p"), o.cast("array<int>").alias("o"), n_words.cast("int").alias("n")), each)


def ensemble(df: DataFrame, source: str, target: str, edges: str, bi_probability: str, cl_probability: str, window: int = 15, alpha: float = 0.8, gate: float = BI_ROLLING, limit: float = 0.45) -> DataFrame:
    """``df`` plus bi_score, cl_score, bi_word_scores, cl_word_scores, has_bi and has_cl of the ensemble, and cleaned_text.

    Peak densities of nine words say whether a pair has insertions (``gate``); word scores mix the density of ``window`` words
    with classifier probabilities; ``limit`` is that of the highest cl word score. Texts that pass the gate lose their inserted spans.
    """
    out = alignment_scores(df, source, target, edges, bi_limit=gate)
    for side, text, chance in (("bi", target, bi_probability), ("cl", source, cl_probability)):
        f = flags(F.size(words(text)), F.transform(F.col(f"{side}_word_mask"), lambda p: p["idx"]))
        scores = F.when(blank_text(source) | blank_text(target), F.array().cast("array<double>")).otherwise(ensemble_scores(f, F.col(chance), window, alpha))
        out = out.withColumn(f"{side}_word_scores", scores)
    out = out.withColumn("has_cl", F.coalesce(F.array_max("cl_word_scores"), F.lit(0.0)) >= limit)
    return gated_clean(out, gate, target)


def ensemble_scores(flag_array: Column, probabilities: Column, window: int = 15, alpha: float = 0.8) -> Column:
    """Per-word mix of the density of unaligned words and classifier probabilities (missing ones count 0)."""
    return F.transform(density(flag_array, window), lambda x, i: alpha * x + (1 - alpha) * F.coalesce(F.get(probabilities, i), F.lit(0.0)))


def gated_clean(df: DataFrame, limit: float = 0.75, text: str = "styled_text", out: str = "cleaned_text") -> DataFrame:
    """Texts cleaned of inserted spans where their bi score reaches the gate, others as they are."""
    from tonewright.operators.spans import cleaned

    return df.withColumn(out, F.when(F.col("bi_score") >= limit, cleaned(text, "bi_word_scores")).otherwise(F.col(text)))


def parse_entities(raw: Sequence[Mapping]) -> tuple[dict[str, list[str]], list[tuple[int, int]]]:
    """Entities by type and their spans from raw (entity_group, word, start, end).

    Only names and places of two letters or more count, sub-word pieces do not. Neighbours at most two characters apart
    become one: places of the same type, and any run of name parts as PERSON.
    """
    merged: list[dict] = []
    for e in raw:
        group, word = e["entity_group"], e["word"]
        if group not in PERSONS + PLACES or word.startswith("##") or len(word) < 2:
            continue
        last = merged[-1] if merged else None
        if last is not None and e["start"] - last["end"] <= 2:
            place = group in PLACES and last["group"] == group
            name = group in PERSONS and last["group"] in (*PERSONS, "PERSON")
            if place or name:
                last.update(group="PERSON" if name else group, word=last["word"] + " " + word, end=e["end"])
                continue
        merged.append({"group": group, "word": word, "start": e["start"], "end": e["end"]})
    found: dict[str, list[str]] = {}
    for m in merged:
        found.setdefault(m["group"], []).append(m["word"])
    return found, [(m["start"], m["end"]) for m in merged]


def suspicious(source: str | Column, target: str | Column, limit: float = SAME_NAME) -> Column:
    """Array of (kind, word) of the target's entities that none of the source resembles, from two map<string,array<string>>
    columns.

    Names may be any name or part of a name of the source, places any place of their kind. Python only compares words, every two
    once a batch.
    """
    nothing = F.array().cast("array<string>")
    s, t = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.map_from_arrays(nothing, F.array().cast("array<array<string>>"))) for c in (source, target))
    names = [*PERSONS, "PERSON"]
    people = F.flatten(F.transform(F.array(*[F.lit(k) for k in names]), lambda k: F.coalesce(F.try_element_at(s, k), nothing)))
    parts = F.flatten(F.transform(people, lambda w: F.when(F.contains(w, F.lit(" ")), F.split(w, " +")).otherwise(nothing)))

    @F.pandas_udf(T.ArrayType(_struct(kind=T.StringType(), word=T.StringType())))
    def unlike(rows: pd.Series, places: pd.Series, people: pd.Series) -> pd.Series:
        best: dict[tuple[str, str], float] = {}

        def resembles(word: str, known: Sequence[str]) -> bool:
            for other in known:
                if (word, other) not in best:
                    best[word, other] = best_string_sim(word, [other])
            return max((best[word, other] for other in known), default=0.0) >= limit

        out = []
        for entities, by_kind, someone in zip(rows, places, people):
            known = dict(by_kind)
            found = ((kind, word, someone if kind in names else known.get(kind, ())) for kind, ws in dict(entities).items() for word in ws)
            out.append([{"kind": kind, "word": word} for kind, word, others in found if not resembles(word, others)])
        return pd.Series(out)

    return unlike(t, s, F.concat(people, parts))


def entity_scores(df: DataFrame, source: str = "source_entities", target: str = "target_entities", limit: float = SAME_NAME) -> DataFrame:
    """``df`` plus suspicious, entity_score = max(0, 1 - strange / entities of the target) and has_substitution."""
    out = df.withColumn("suspicious", suspicious(source, target, limit))
    count = F.aggregate(F.map_values(F.coalesce(F.col(target), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>")))), F.lit(0), lambda s, v: s + F.size(v))
    strange = F.size("suspicious")
    return out.withColumn("entity_score", F.greatest(F.lit(0.0), 1.0 - strange / F.greatest(count, F.lit(1)))).withColumn("has_substitution", strange > 0)


@F.pandas_udf(_struct(by_type=T.MapType(T.StringType(), T.ArrayType(T.StringType())), spans=T.ArrayType(_struct(start=T.IntegerType(), end=T.IntegerType()))))
def parsed_entities(raw: pd.Series) -> pd.DataFrame:
    """Column of ``parse_entities`` from array<struct<entity_group,word,start,end>>; nothing for null."""
    found = [parse_entities([e if isinstance(e, dict) else e.asDict() for e in (r if r is not None else ())]) for r in raw]
    return pd.DataFrame({"by_type": [f[0] for f in found], "spans": [[{"start": s, "end": e} for s, e in f[1]] for f in found]})


@F.pandas_udf(_struct(precision=T.DoubleType(), recall=T.DoubleType(), f1=T.DoubleType()))
def token_scores(source: pd.Series, target: pd.Series, source_mask: pd.Series, target_mask: pd.Series) -> pd.DataFrame:
    """Column of ``entity_token_scores`` from token vectors (array<array<double>>, scaled to norm 1 here) and masks."""
    def matrix(v):
        x = np.stack([np.asarray(r, dtype=float) for r in v]) if v is not None and len(v) else np.zeros((0, 1))
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    rows = [entity_token_scores(matrix(s), matrix(t), np.asarray(a, dtype=bool), np.asarray(b, dtype=bool)) for s, t, a, b in zip(source, target, source_mask, target_mask)]
    return pd.DataFrame(rows, columns=["precision", "recall", "f1"])


def entity_pair_scores(df: DataFrame, source: str, target: str, extract, clean: Column | None = None, precision: str | None = None, limit: float = SAME_NAME) -> DataFrame:
    """``df`` plus source_entities, target_entities, suspicious, entity_score, has_substitution and, with the column
    ``precision``, combined_entity_score: the whole-pair scorer.

    ``extract`` adds a column ``raw`` (array<struct<entity_group,word,start,end>>) to a frame with a column ``text`` of distinct
    texts, each read once. ``clean`` may stand in for the target. A blank side scores 1 throughout.
    """
    from tonewright.functions.scores import combined_entity

    rows = df.withColumn("_target", clean if clean is not None else F.col(target))
    texts = rows.select(F.col(source).alias("text")).unionByName(rows.select(F.col("_target").alias("text"))).filter("text is not null").distinct()
    known = extract(texts).select("text", parsed_entities("raw")["by_type"].alias("_e"))
    for side, column in (("source", source), ("target", "_target")):
        rows = rows.join(known.select(F.col("text").alias(column), F.col("_e").alias(f"{side}_entities")), column, "left")
    out = entity_scores(rows, limit=limit)
    blank = blank_text(source) | blank_text("_target")
    out = out.withColumn("entity_score", F.when(blank, 1.0).otherwise(F.col("entity_score"))).withColumn("has_substitution", ~blank & F.col("has_substitution"))
    if precision is not None:
        out = out.withColumn("combined_entity_score", F.when(blank, 1.0).otherwise(combined_entity("entity_score", precision)))
    return out.drop("_target")


def bag_similarity(source_vector: str, target_vector: str, source_bag: str, target_bag: str) -> Column:
    """1 for two empty bags, 0 for one, else the product of their unit vectors."""
    from tonewright.functions.vector import dot

    a, b = (F.coalesce(F.col(c), F.lit("")) == "" for c in (source_bag, target_bag))
    return F.when(a & b, 1.0).when(a | b, 0.0).otherwise(dot(source_vector, target_vector))


def entity_token_scores(source: np.ndarray, target: np.ndarray, source_mask: np.ndarray, target_mask: np.ndarray) -> tuple[float, float, float]:
    """Precision, recall and F1 of entity tokens against all tokens of the other side (unit vectors, cosines floored
    at 0); a side without entities counts 1."""
    def side(rows, others):
        return float(np.clip((rows @ others.T).max(1), 0, None).mean()) if len(rows) and len(others) else 1.0 if not len(rows) else 0.0

    precision, recall = side(target[target_mask], source), side(source[source_mask], target)
    return precision, recall, 2 * precision * recall / (precision + recall) if precision + recall else 0.0


def gender_tokens(tagged: str | Column) -> tuple[Column, Column]:
    """(whether a singular pronoun occurs, array of genders) from array<struct<word,tag>>, tags like POS|A=v|B=w.

    Singular pronouns, singular past verbs and short adjectives carry gender.
    """
    t = F.filter(F.col(tagged) if isinstance(tagged, str) else tagged, lambda x: F.coalesce(x["tag"], F.lit("")) != "")

    def attr(tag, name):
        return F.nullif(F.regexp_extract(tag, rf"\|{name}=([^|]*)", 1), F.lit(""))

    def pos(tag):
        return F.substring_index(tag, "|", 1)

    def carries(x):
        tag = x["tag"]
        single = F.coalesce(attr(tag, "Number") == "Sing", F.lit(False))
        return (
            ((pos(tag) == "PRON") & single)
            | ((pos(tag) == "VERB") & single & F.coalesce(attr(tag, "Tense") == "Past", F.lit(False)))
            | ((pos(tag) == "ADJ") & F.coalesce(attr(tag, "Variant") == "Short", F.lit(False)))
        )

    active = F.exists(t, lambda x: (pos(x["tag"]) == "PRON") & F.coalesce(attr(x["tag"], "Number") == "Sing", F.lit(False)))
    genders = F.filter(F.transform(F.filter(t, carries), lambda x: attr(x["tag"], "Gender")), lambda g: g.isNotNull())
    return active, genders


def gender_map(text: str, tokens: Sequence[tuple[int, int, str | None]]) -> dict[int, str]:
    """Gender of each white-space word from tokens (start, end, tag) that lie within it; the last token of a word wins."""
    import re

    spans = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    out: dict[int, str] = {}
    i = 0
    for start, end, tag in sorted(tokens, key=lambda t: t[0]):
        attrs = dict(p.split("=", 1) for p in (tag or "").split("|")[1:] if "=" in p)
        if attrs.get("Gender") not in ("Masc", "Fem"):
            continue
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        if i < len(spans) and spans[i][0] <= start and end <= spans[i][1]:
            out[i] = attrs["Gender"]
    return out


@F.pandas_udf(T.MapType(T.IntegerType(), T.StringType()))
def gender_maps(texts: pd.Series, tokens: pd.Series) -> pd.Series:
    """Column of ``gender_map`` from texts and array<struct<start,end,tag>>; null for a null text."""
    def one(text, toks):
        return None if text is None else gender_map(text, [(t["start"], t["end"], t["tag"]) for t in (toks if toks is not None else ())])

    return pd.Series([one(x, y) for x, y in zip(texts, tokens)])


def edge_agreement(edges: str | Column, source_map: str | Column, target_map: str | Column) -> Column:
    """Share of edges between gendered words whose genders agree; 1 without such edges."""
    e = F.col(edges) if isinstance(edges, str) else edges
    s, t = (F.col(c) if isinstance(c, str) else c for c in (source_map, target_map))
    both = F.filter(e, lambda x: F.try_element_at(s, x["i"]).isNotNull() & F.try_element_at(t, x["j"]).isNotNull())
    same = F.filter(both, lambda x: F.try_element_at(s, x["i"]) == F.try_element_at(t, x["j"]))
    return F.coalesce(F.try_divide(F.size(same), F.when(F.size(both) > 0, F.size(both))), F.lit(1.0))


def gender_scores(
    df: DataFrame, source_tags: str = "source_tags", target_tags: str = "target_tags", edges: str = "edges", source_map: str = "source_gender", target_map: str = "target_gender", limit: float = 0.80,
    source_text: str | None = None, target_text: str | None = None,
) -> DataFrame:
    """``df`` plus gender_score (mean of distribution and agreement), gender_activated and has_switch.

    Without a singular pronoun in the source the distribution counts 1 and the score is not activated. A pair with a blank side
    (``source_text``, ``target_text``, where given) scores 1 and is not activated.
    """
    from tonewright.functions.scores import distribution_score

    active, source = gender_tokens(source_tags)
    _, target = gender_tokens(target_tags)
    a = F.when(active, distribution_score(source, target)).otherwise(1.0)
    b = edge_agreement(edges, source_map, target_map)
    blank = F.lit(False)
    for text in (source_text, target_text):
        if text is not None:
            blank = blank | blank_text(text)
    out = df.withColumn("gender_activated", ~blank & F.coalesce(active, F.lit(False)))
    out = out.withColumn("gender_score", F.when(blank, 1.0).otherwise((F.coalesce(a, F.lit(1.0)) + F.coalesce(b, F.lit(1.0))) / 2))
    return out.withColumn("has_switch", F.col("gender_score") < limit)
