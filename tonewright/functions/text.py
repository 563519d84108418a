"""Word-level text expressions, and window operators over the words of a text (survey X1-X4, X16, X17, W1-W5).

Regular expressions use Unicode classes; white space and word characters are those of Unicode. Null texts give
null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonewright.functions.vector import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text, most: int | None = None) -> Column:
    """White-space separated words, at most ``most`` of them."""
    out = F.filter(F.split(_c(text), r"(?U)\s+"), lambda w: w != "")
    return F.slice(out, 1, most) if most is not None else out


def clean_word(word) -> Column:
    """A word without the punctuation around it; a word of punctuation only stays as it is."""
    bare = F.regexp_replace(_c(word), r"(?U)^\W+|\W+$", "")
    return F.when(bare == "", _c(word)).otherwise(bare)


def clean_words(text, most: int | None = None) -> Column:
    return F.transform(words(text, most), clean_word)


def author_tag(author) -> Column:
    """<lower_case_with_underscores>"""
    return F.concat(F.lit("<"), F.replace(F.lower(_c(author)), F.lit(" "), F.lit("_")), F.lit(">"))


def tag_style(tag) -> Column:
    """The style a tag names: first letter upper, the rest lower."""
    inner = F.substring(_c(tag), F.lit(2), F.length(_c(tag)) - 2)
    return F.concat(F.upper(F.substring(inner, 1, 1)), F.lower(F.substring(inner, F.lit(2), F.length(inner))))


def prompt(style_tag, text) -> Column:
    """Model input with the tag in front."""
    return F.concat(_c(style_tag), F.lit(" "), _c(text))


def decoded(output, style_tag, eos: str) -> Column:
    """What a causal model wrote: behind the first tag, up to the end mark, trimmed; trimmed whole without a tag."""
    o, t = _c(output), _c(style_tag)
    at = F.position(t, o)
    parts = F.split_part(F.substring(o, at + F.length(t), F.length(o)), F.lit(eos), F.lit(1))
    return F.regexp_replace(F.when(at > 0, parts).otherwise(o), r"(?U)^\s+|\s+$", "")


def flags(total, unaligned) -> Column:
    """Array of ``total`` zeros with ones at the positions of ``unaligned``."""
    def mark(u):
        n = _c(total)
        marks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains(u, i).cast("int"))
        return F.when(n > 0, marks).otherwise(F.array().cast("array<int>"))

    return let(_c(unaligned), mark)


def density(flag_array, window: int = 9) -> Column:
    """Share of flags in a window around each word, over the words the window has in bounds.

    With s = floor((min(n, window) - 1) / 2), the window of word i is i + s - window + 1 to i + s.
    """
    def slide(f):
        n = F.size(f)
        shift = F.floor((F.least(n, F.lit(window)) - 1) / 2).cast("int")

        def at(i):
            low = F.greatest(i + shift - (window - 1), F.lit(0))
            width = F.least(i + shift, n - 1) - low + 1
            return F.aggregate(F.slice(f, low + 1, width), F.lit(0), lambda s, x: s + x) / width

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), at)).otherwise(F.array().cast("array<double>"))

    return let(_c(flag_array), slide)


def peak_density(flag_array, window: int = 9) -> Column:
    """Highest density; 0 without flags."""
    return F.coalesce(F.array_max(density(flag_array, window)), F.lit(0.0))


def span_score(flag_array, min_span: int = 4) -> Column:
    """Share of words in runs of at least ``min_span`` flagged words; every flagged word counts for spans up to 1."""
    if isinstance(flag_array, str):
        flag_array = F.col(flag_array)
    return let(flag_array, lambda f: _span_score(f, min_span))


def _span_score(f: Column, min_span: int) -> Column:
    n = F.size(f)
    if min_span <= 1:
        hits = F.aggregate(f, F.lit(0), lambda s, x: s + x)
    else:
        start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("hits"))

        def step(s, x):
            run = F.when(x == 1, s["run"] + 1).otherwise(0)
            gain = F.when(run == min_span, min_span).when(run > min_span, 1).otherwise(0)
            return F.struct(run.alias("run"), (s["hits"] + gain).alias("hits"))

        hits = F.aggregate(f, start, step)["hits"]
    return F.when(n > 0, hits / n).otherwise(0.0)


def running_shares(counts) -> Column:
    """Running sums of an array over its total, without the last; empty for arrays of up to one element and null for null.

    Each element sums its own prefix, which the JVM does over primitive arrays; nothing is copied.
    """
    def shares(c):
        n = F.size(c)
        add = lambda s, x: s + x
        total = F.aggregate(c, F.lit(0.0), add)
        prefix = lambda i: F.try_divide(F.aggregate(F.slice(c, 1, i), F.lit(0.0), add), total)
        return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), prefix)).otherwise(F.array().cast("array<double>"))

    c = _c(counts).cast("array<double>")
    return F.when(c.isNotNull(), let(c, shares))
