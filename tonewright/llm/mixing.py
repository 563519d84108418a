"""Mixing sources to target weights by Pareto order sampling.

A source's tokens in a mix are its share of the wanted size, limited by ``max_repeats`` times what it has; what
a short source leaves over goes to the others in proportion to their shares. Every document of a source is then owed some
copies: rows of the same text share those of one, as far as ``max_repeats`` allows, so that no text counts more for having
been delivered more often. Whole copies are certain, and the rest is drawn: documents are ranked by random odds over
their own inclusion odds (Pareto order sampling) and taken from the smallest rank on until the tokens are reached.

The place where the drawing stops is found without sorting a source: ranks are counted in 4,096 bins, the bin
of the cut again in 4,096, and only the rows of that last bin (one in 16 million) are put in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonewright.llm.tokens import HEAD_WORDS, token_sizes
from tonewright.session import cut

BINS = 4096
#: Most rows of the table of targets, which is a setting and is read by the driver.
MOST_TARGETS = 10_000


@dataclass(frozen=True)
class Share:
    """What one source gives to one mix."""

    mix: str
    source: str
    target_share: float
    max_repeats: int
    wanted: float
    available: int
    tokens: float


def allocate(targets: list[dict], available: dict[str, int], total: int) -> list[Share]:
    """Tokens of each (mix, source): shares of the wanted size within the caps on repeats.

    The level ``x`` solves ``sum(min(cap, share * x)) = min(wanted, sum(cap))``. Shares of a mix are scaled to
    add up to 1; null or negative shares and repeats count as 0.
    """
    mixes: dict[str, list[dict]] = {}
    for t in targets:
        mixes.setdefault(t["mix_name"], []).append(t)
    out = []
    for mix, rows in mixes.items():
        size = max((r["size_ratio"] or 0.0) for r in rows) * total
        shares = [max(r["target_share"] or 0.0, 0.0) for r in rows]
        whole = sum(shares) or 1.0
        shares = [s / whole for s in shares]
        repeats = [max(int(r["max_repeats"] or 0), 0) for r in rows]
        have = [available.get(r["source"], 0) for r in rows]
        caps = [float(n * h) for n, h in zip(repeats, have)]
        given = [0.0] * len(rows)
        open_ = {i for i in range(len(rows)) if shares[i] > 0 and caps[i] > 0}
        left = min(size, sum(caps[i] for i in open_))
        while open_:
            weight = sum(shares[i] for i in open_)
            full = {i for i in open_ if shares[i] / weight * left >= caps[i]}
            if not full:
                for i in open_:
                    given[i] = shares[i] / weight * left
                break
            for i in full:
                given[i] = caps[i]
                left -= caps[i]
            open_ -= full
            left = max(left, 0.0)
        out += [
            Share(mix, r["source"], shares[i], repeats[i], shares[i] * size, have[i], given[i]) for i, r in enumerate(rows)
        ]
    return out


def owed(tokens: float, sums: dict[int, int], most: int) -> dict[int, float]:
    """Copies owed to a document by how often its text occurs, from the tokens of each such class: ``min(most, x / times)`` with
    the ``x`` that gives ``tokens`` in all."""
    left, full = tokens, {}
    for times in sorted(sums):  # rarer texts reach the cap first
        x = left / sum(t / k for k, t in sums.items() if k not in full)
        if x / times < most:
            return full | {k: x / k for k in sums if k not in full}
        full[times] = float(most)
        left = max(left - most * sums[times], 0.0)
    return full


def _bin_of_cut(rows: DataFrame, keys: list[str], bin_col: str, rest: str) -> DataFrame:
    """For each stratum the bin in which ``rest`` tokens are reached, and the tokens before it."""
    sums = rows.groupBy(*keys, rest, bin_col).agg(F.sum("n_tokens").alias("_sum"))
    order = W.partitionBy(*keys).orderBy(bin_col)  # at most BINS rows a stratum
    sums = sums.withColumn("_upto", F.sum("_sum").over(order))
    return (
        sums.filter((F.col("_upto") >= F.col(rest)) & (F.col("_upto") - F.col("_sum") < F.col(rest)))
        .select(*keys, F.col(bin_col).alias(f"{bin_col}_cut"), (F.col(rest) - F.col("_upto") + F.col("_sum")).alias(f"{rest}_in"))
    )


def mix_sources(
    docs: DataFrame, targets: DataFrame, id_col: str, text: str, source: str, path: str | None = None,
    seed: int = 7, head_words: int = HEAD_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Draw the mixes of ``targets`` (mix_name, source, target_share, max_repeats, size_ratio) from ``docs``.

    Returns two tables. The mix: (mix_name, id_col, source, n_tokens, copies), one row per document and mix with
    at least one copy, never more than ``max_repeats``. The report: (mix_name, source, target_share,
    max_repeats, wanted_tokens, available_tokens, tokens, share, n_docs, n_copies), one row per row of
    ``targets``, sources without documents included with zeros.

    The wanted size of a mix is ``size_ratio`` of the tokens of all documents, those of null or unlisted sources
    included. Documents without tokens (null and empty texts) add nothing and are never drawn; a null source
    belongs to no mix. Repeated rows are separate documents that share the copies of their text; how often a text occurs in its
    source counts in powers of two. The draw depends on ``seed``, the mix, the id and
    the text only, so it is the same for any partitioning. Empty tables give an empty mix.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source}`").alias("source"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.col(f"`{text}`")).alias("h"), F.xxhash64(F.col(f"`{text}`")).alias("same"),
        F.col(f"`{text}`").alias("text"),
    )
    sizes = cut(token_sizes(rows, "text", path, head_words=head_words).filter("n_tokens > 0"))
    repeated = sizes.groupBy("source", "same").agg(F.count("*").alias("times")).filter("times > 1")
    sizes = sizes.join(repeated, ["source", "same"], "left").withColumn("times", F.pow(F.lit(2), F.floor(F.log2(F.coalesce("times", F.lit(1))))).cast("long")).drop("same")
    wanted = targets.select(
        "mix_name", "source", F.col("target_share").cast("double"), F.col("max_repeats").cast("int"), F.col("size_ratio").cast("double")
    ).limit(MOST_TARGETS + 1).collect()
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} rows of targets")
    names = spark.createDataFrame([(n,) for n in {r["source"] for r in wanted if r["source"]}] or [("",)], "source string").filter("source <> ''")
    sums = cut(sizes.groupBy("source", "times").agg(F.sum("n_tokens").alias("t")))
    total = sums.agg(F.sum("t")).first()[0] or 0
    classes: dict[str, dict[int, int]] = {}
    for r in sums.join(names, "source", "left_semi").collect():  # at most 63 a source
        classes.setdefault(r["source"], {})[r["times"]] = r["t"]
    available = {s: sum(c.values()) for s, c in classes.items()}
    shares = allocate([r.asDict() for r in wanted], available, total)

    strata = []
    for s in shares:
        if s.tokens <= 0:
            continue
        copies = owed(s.tokens, classes[s.source], s.max_repeats)
        parts = {k: (int(c + 1e-9), max(c - int(c + 1e-9), 0.0)) for k, c in copies.items()}
        rest = sum(odds * classes[s.source][k] for k, (_, odds) in parts.items())
        strata += [(s.mix, s.source, k, certain, odds, rest) for k, (certain, odds) in parts.items()]
    plan = spark.createDataFrame(strata, "mix_name string, source string, times long, certain int, odds double, rest double")
    drawn = sizes.join(F.broadcast(plan), ["source", "times"])  # at most 63 rows a target
    u = (F.shiftrightunsigned(F.xxhash64("h", "mix_name"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    # Pareto rank: odds of a uniform number over the odds of inclusion; ranks x in (0, inf) become x / (1 + x)
    x = (F.col("u") / (1 - F.col("u"))) / (F.col("odds") / (1 - F.col("odds")))
    drawn = drawn.withColumn("u", u).withColumn("rank", F.when(F.col("odds") > 0, x / (1 + x)))
    drawn = drawn.withColumn("b1", F.floor(F.col("rank") * BINS)).withColumn(
        "b2", F.floor((F.col("rank") * BINS - F.col("b1")) * BINS)
    )
    keys = ["mix_name", "source"]
    open_ = drawn.filter("odds > 0")
    first = _bin_of_cut(open_, keys, "b1", "rest")
    inside = open_.join(F.broadcast(first), keys).filter("b1 = b1_cut")
    second = _bin_of_cut(inside, [*keys, "b1_cut"], "b2", "rest_in")
    last = inside.join(F.broadcast(second.drop("b1_cut")), keys).filter("b2 = b2_cut")
    order = W.partitionBy(*keys).orderBy("rank", "h")
    last = last.withColumn("_upto", F.sum("n_tokens").over(order))
    # the document in which the tokens are reached is taken when that comes closer than leaving it out
    taken = last.filter(F.col("_upto") - F.col("n_tokens") / 2 <= F.col("rest_in_in"))
    ends = taken.groupBy(*keys).agg(F.max(F.struct("rank", "h")).alias("end"))
    cuts = first.select(*keys, "b1_cut").join(F.broadcast(second.select(*keys, "b2_cut")), keys, "left").join(F.broadcast(ends), keys, "left")
    cuts = cut(cuts)  # one row per stratum
    marked = drawn.join(F.broadcast(cuts), keys, "left")
    extra = (
        (F.col("b1") < F.col("b1_cut"))
        | ((F.col("b1") == F.col("b1_cut")) & (F.col("b2") < F.col("b2_cut")))
        | ((F.col("b1") == F.col("b1_cut")) & (F.col("b2") == F.col("b2_cut")) & (F.struct("rank", "h") <= F.col("end")))
    )
    mix = (
        marked.withColumn("copies", F.col("certain") + F.when(F.coalesce(extra, F.lit(False)), 1).otherwise(0))
        .filter("copies > 0")
        .select("mix_name", F.col("id").alias(id_col), "source", "n_tokens", "copies")
    )
    got = mix.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies")
    )
    listed = spark.createDataFrame(
        [(s.mix, s.source, s.target_share, s.max_repeats, s.wanted, s.available) for s in shares],
        "mix_name string, source string, target_share double, max_repeats int, wanted_tokens double, available_tokens long",
    )
    report = F.broadcast(listed).join(got, keys, "left").na.fill(0, ["tokens", "n_docs", "n_copies"])
    whole = W.partitionBy("mix_name")  # at most MOST_TARGETS rows
    report = report.withColumn("share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(whole)), F.lit(0.0)))
    columns = ["mix_name", "source", "target_share", "max_repeats", "wanted_tokens", "available_tokens", "tokens", "share", "n_docs", "n_copies"]
    return mix, report.select(*columns)
