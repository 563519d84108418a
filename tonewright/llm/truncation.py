"""Texts cut off by field limits: values that end inside a word or a sentence, and the rate of each source.

The distinct values of all fields are range-partitioned and sorted, so that every value that is a strict prefix
of a longer copy stands beside one (a self-join by prefix without a join). Values that differ only in the mark
behind the same break pass as one, so that each is compared with the next different one. What follows the prefix in the longer
copy tells whether the value stops inside a word or sentence. Most cut values have no longer copy, so the same
question is put to smaller units:

* words: a last word never seen whole elsewhere that is a strict prefix of longer words of the corpus,
* sentences: the last words of a value as a prefix signature; the sentences of all values tell how often a signature
  ends a sentence and how often it only stands inside one.

Words, prefixes and signatures are counted over all distinct values. Of the signatures only those that some open value
may ask for are counted: a bitmap of fixed size, made beforehand, drops most others, and a join finds the counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.folding import LOOK_ALIKES, fold
from tonewright.session import cut

#: Bits of the map of signatures that are asked for (as a power of two), and least count of a signature in use.
MAP_BITS, LEAST_SEEN = 27, 4
#: Most words of a closing formula, and how many times more frequent than the whole word its longer words are when it is
#: broken.
FORMULA, RARER = 3, 100
#: Words and distinct words that a task counts before it passes on what it has.
PENDING, KNOWN = 200_000, 400_000
#: Lengths of signatures in words.
LENGTHS = (1, 2, 3, 4, 5, 6, 8, 10, 12)
FINE = 5
#: A value stops inside a sentence when its signature ends fewer of its sentences: without a mark, with a weak mark.
OPEN_SHARE, WEAK_SHARE = 0.35, 0.2
#: What is put behind a break. Strong marks are used for breaks only.
STRONG = re.compile(r"(?:�|\[\s*(?:\.\.\.|…)\s*\]|<\s*(?:\.\.\.|…)\s*>|\((?:обрезано|cut|truncated)\)|\[(?:обрезано|cut|truncated)\])[\s.…]*$", re.I)
WEAK = re.compile(r"(?:…|\.{2,})\s*$")
_BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_UNSEEN = _BLANK + "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
_CLOSED = re.compile(r"[.!?)\]»”\"'*>]$|[\U0001F000-\U0001FAFF☀-➿️]$")
_OPEN_TAIL = re.compile(r"[,:;(«“\[]$|\s[—–-]$")
_UNIT = re.compile(r"(?<=[.!?…)»\"])\s+(?=[«\"—–(-]{0,2}\s?[A-ZА-ЯЁІЇЄ0-9])|\n+")
_WORD = re.compile(r"[^\W_]+")
_TABLE = str.maketrans(LOOK_ALIKES)
_FACTORS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
            0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7]
_START = 0x5851F42D4C957F2D
_MASK = (1 << 64) - 1


_ALIKE: dict[str, str] = {}


def _words(text: str) -> list[str]:
    """Folded words with look-alike letters as one; the form of a word is remembered."""
    out = []
    for w in _WORD.findall(fold(text)):
        form = _ALIKE.get(w)
        if form is None:
            if len(_ALIKE) > 500_000:
                _ALIKE.clear()
            form = _ALIKE[w] = w.translate(_TABLE)
        out.append(form)
    return out


class _Classes:
    """Word classes by their endings, remembered as hashes: of three, two and one letters; short words stand for themselves."""

    def __init__(self):
        self.known: dict[str, tuple[int, int, int, int]] = {}

    def of(self, word: str) -> tuple[int, int, int, int]:
        """Classes near the end and further away in a short signature, and the same in a long one."""
        got = self.known.get(word)
        if got is None:
            import xxhash

            if len(self.known) > 200_000:
                self.known.clear()
            name = "#" if word[0].isdigit() else word
            endings = [name if len(name) <= kept else "~" + name[-letters:] for kept, letters in ((4, 3), (3, 2), (3, 2), (3, 1))]
            got = self.known[word] = tuple(xxhash.xxh3_64_intdigest(e) for e in endings)
        return got


def signatures(words: list[str], at: int, classes: _Classes) -> list[int]:
    """Hashes of the signatures that end with word ``at``, by rising length, up to where the sentence begins.

    Signatures of up to ``FINE`` words use fine classes, longer ones coarse classes.
    """
    out, fine, coarse = [], 0, 1
    for k in range(LENGTHS[-1]):
        i = at - k
        if i < 0:
            out.append(((fine if k < FINE else coarse) + _START * _FACTORS[k]) & _MASK)
            break
        near, far, near_c, far_c = classes.of(words[i])
        factor = _FACTORS[k]
        fine = (fine + (near if k < 2 else far) * factor) & _MASK
        coarse = (coarse + (near_c if k < 2 else far_c) * factor) & _MASK
        if k + 1 in LENGTHS:
            out.append(fine if k < FINE else coarse)
    return out


def core_of(value: str) -> tuple[str, str]:
    """A value without what stands behind its possible break, and the kind of that: '', 'weak' or 'strong'."""
    kind = ""
    while True:
        value = value.rstrip(_UNSEEN)
        if value.rstrip(_BLANK + ".…")[-1:] in ("�", "]", ">", ")") and (m := STRONG.search(value)):
            kind, value = "strong", value[: m.start()]
        elif value.endswith(("…", "..")) and (m := WEAK.search(value)):
            kind, value = kind or "weak", value[: m.start()]
        else:
            return value, kind


def continuation(core: str, neighbour: str | None) -> str:
    """What a longer copy says of a value: 'cut', 'whole' or ''."""
    if not core or not neighbour or len(neighbour) <= len(core) or not neighbour.startswith(core):
        return ""
    rest = core_of(neighbour)[0][len(core) :]
    if not rest:
        return ""
    if rest[0].isalnum() and core[-1:].isalnum():
        return "cut"
    if re.match(r"[\s,;:—–-]*[^\W_]", rest) and not _CLOSED.search(core):
        return "cut" if not rest.startswith("\n") else ""
    return "whole"


class _Vocabulary(dict):
    """Numbers of folded words; words of one form have one number."""

    def __init__(self, classes: _Classes):
        super().__init__()
        self.classes, self.by_form = classes, {}
        self.forms: list[str] = []
        self.rows: list[tuple[int, int, int, int]] = []
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        form = word.translate(_TABLE)
        i = self.by_form.get(form)
        if i is None:
            import xxhash

            i = self.by_form[form] = len(self.forms)
            self.forms.append(form)
            self.rows.append(self.classes.of(form))
            self.hashes.append(xxhash.xxh3_64_intdigest(form))
        self[word] = i
        return i

    def of(self, text: str) -> list[int]:
        return list(map(self.__getitem__, _WORD.findall(fold(text))))


class _Counts:
    """Counts of a task: its words, the openings of its sentences, and the signatures of whole sentences that are in ``bitmap``,
    all sentences since the last call at a time."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap, self.classes = bitmap, _Classes()
        self.begin()

    def begin(self) -> None:
        self.words = _Vocabulary(self.classes)
        self.ids: list[int] = []  # of whole sentences
        self.sizes: list[int] = []
        self.others: list[int] = []  # whole words of last sentences
        self.seen = np.zeros(0, dtype=np.int64)
        self.openings: set[int] = set()

    def add(self, words: list[int]) -> None:
        self.ids += words
        self.sizes.append(len(words))

    def opening(self, words: list[int]) -> int:
        """The key of some first words."""
        hashes = self.words.hashes
        return (sum(hashes[w] * f for w, f in zip(words, _FACTORS)) + len(words) * _START) & _MASK

    def begun(self, words: list[int]) -> None:
        for k in range(1, min(FORMULA, len(words) - 1) + 1):
            self.openings.add(self.opening(words[:k]))

    def add_up(self) -> None:
        """Words and openings of what is pending."""
        ids, sizes = np.array(self.ids, dtype=np.int64), np.array(self.sizes, dtype=np.int64)
        n = len(self.words.forms)
        self.seen = np.concatenate([self.seen, np.zeros(n - len(self.seen), dtype=np.int64)])
        self.seen += np.bincount(ids, minlength=n) + np.bincount(np.array(self.others, dtype=np.int64), minlength=n)
        self.others = []
        first, hashes = np.cumsum(sizes) - sizes, np.array(self.words.hashes, dtype=np.uint64)
        for k in range(1, FORMULA + 1):
            at = first[sizes > k]
            key = np.full(len(at), k * _START & _MASK, dtype=np.uint64)
            for j in range(k):
                key += hashes[ids[at + j]] * np.uint64(_FACTORS[j])
            self.openings.update(np.unique(key).tolist())

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, ends, inside) of the sentences since the last call: those of ``signatures`` at each of their words."""
        sizes = np.array(self.sizes, dtype=np.int64)
        self.add_up()
        near, far, near_c, far_c = np.array(self.words.rows, dtype=np.uint64).reshape(-1, 4)[np.array(self.ids, dtype=np.int64)].T.copy()
        at = np.arange(len(near)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        end = at == np.repeat(sizes, sizes) - 1
        fine, coarse = np.zeros(len(at), dtype=np.uint64), np.ones(len(at), dtype=np.uint64)
        keys, ends = [], []

        def put(key, last):
            met = in_map(self.bitmap, key)
            keys.append(key[met])
            ends.append(last[met])

        for k in range(LENGTHS[-1]):
            first, rest = at == k - 1, at >= k
            if first.any():
                put((fine if k < FINE else coarse)[first] + np.uint64(_START * _FACTORS[k] & _MASK), end[first])
            if not rest.any():
                break
            # what is added across the beginning of a sentence stands in words that are done
            factor, n = np.uint64(_FACTORS[k]), len(at) - k
            fine[k:] += (near if k < 2 else far)[:n] * factor
            coarse[k:] += (near_c if k < 2 else far_c)[:n] * factor
            if k + 1 in LENGTHS:
                put((fine if k < FINE else coarse)[rest], end[rest])
        self.ids, self.sizes = [], []
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        last = np.bincount(place, weights=np.concatenate(ends), minlength=len(key)).astype(np.int64)
        return key.view(np.int64), last, np.bincount(place, minlength=len(key)) - last


def in_map(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = keys & np.uint64((1 << MAP_BITS) - 1)
    return (bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def asked_signatures(values: DataFrame) -> np.ndarray:
    """The bitmap of the signatures at the end of the ``values`` that are open, by their last bits."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _Classes()
        for batch in batches:
            keys: set[int] = set()
            for value in batch.column(0).to_pylist():
                core, mark = core_of(value)
                if mark == "strong" or _CLOSED.search(core[-2:]):
                    continue
                units = [u for u in _UNIT.split(core) if u and not u.isspace()]
                if units and (words := _words(units[-1])):
                    keys.update(signatures(words, len(words) - 1, classes))
            slots = np.unique(np.array(list(keys), dtype=np.uint64) & np.uint64((1 << MAP_BITS) - 1))
            bits = np.left_shift(np.uint64(1), slots & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int32)), pa.array(bits.view(np.int64))], names=["at", "bits"])

    found = values.mapInArrow(ask, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(1 << MAP_BITS - 6, dtype=np.uint64)
    bitmap[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bitmap


def _describe(core: str, mark: str, units: list[str], words: list, before: str | None, after: str | None) -> tuple[str, bool]:
    """Verdict ('cut', 'whole', '?' for the signature to decide, '' for the words alone to decide) and whether the core
    is closed. ``units`` are the sentences of the core, ``words`` the words of the last."""
    closed = bool(_CLOSED.search(core[-2:]))
    if not words:
        return "whole", closed
    if closed and mark != "strong":
        # only a false full stop behind a broken word is left to find
        return ("" if core[-1] in ".!?" and core[-2:-1].isalnum() else "whole"), True
    for neighbour in (after, before):
        if not closed and continuation(core, neighbour) == "cut":
            return "cut", closed
    if mark == "strong":
        return ("whole" if closed else "cut"), closed
    if _OPEN_TAIL.search(core[-3:]):
        return "cut", closed
    unit = units[-1]
    if unit.count("«") > unit.count("»") or unit.count("“") > unit.count("”"):
        return "cut", closed
    return "?", closed


def _hashes(column):
    return F.xxhash64(column), F.xxhash64(F.lit(29), column)


def _by_signature(seen: DataFrame) -> DataFrame:
    """(h1, h2, verdict, word): the values of ``seen``, open ones decided by the longest of their signatures that is known."""
    judged = seen.filter("kind = 'value'").select("h1", "h2", "verdict", "word", "keys")
    counts = seen.filter("kind = 'signature'").groupBy(F.col("h1").alias("key")).agg(F.sum("n").alias("ends"), F.sum("h2").alias("inside"))
    counts = counts.filter(F.col("ends") + F.col("inside") >= LEAST_SEEN)
    share = (F.col("ends") + 0.3) / (F.col("ends") + F.col("inside") + 0.6)
    asked = judged.filter("keys is not null").select("h1", "h2", F.posexplode("keys").alias("at", "key"))
    shares = asked.join(counts.select("key", share.alias("share")), "key").groupBy("h1", "h2").agg(F.max_by("share", "at").alias("share"))
    least = F.when(F.contains("verdict", F.lit("weak")), WEAK_SHARE).otherwise(OPEN_SHARE)
    unknown = F.when(F.endswith("verdict", F.lit("other")), "whole").otherwise("whole?")
    guess = F.when(F.col("share").isNull(), unknown).when(F.col("share") < least, "cut?").otherwise("whole?")
    met = judged.join(shares, ["h1", "h2"], "left")
    return cut(met.select("h1", "h2", F.when(F.col("keys").isNull(), F.col("verdict")).otherwise(guess).alias("verdict"), "word"))


def cut_values(values: DataFrame) -> DataFrame:
    """(h1, h2): hashes of the distinct ``values`` (one column, value string) that were cut."""
    spark = values.sparkSession
    bitmap = spark.sparkContext.broadcast(asked_signatures(values))

    def sorted_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(bitmap.value)
        classes = counts.classes
        out: list[list] = [[], [], [], [], [], [], []]
        before: str | None = None
        group: list[tuple] = []  # the last values, of one core
        held: str | None = None
        groups = 0

        def flush():
            kinds = out[0]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()),
                 pa.array(out[4], pa.string()), pa.array(out[5], pa.int64()), pa.array(out[6], pa.list_(pa.int64()))],
                names=["kind", "h1", "h2", "verdict", "word", "n", "keys"],
            )
            for column in out:
                column.clear()
            return batch

        def put(*row, keys=None):
            for column, value in zip(out, (*row, keys)):
                column.append(value)

        def count():
            key, ends, inside = counts.take()
            none = [None] * len(key)
            for column, value in zip(out, (["signature"] * len(key), key.tolist(), inside.tolist(), none, none, ends.tolist(), none)):
                column.extend(value)

        def tell():
            forms = counts.words.forms
            for i in np.flatnonzero(counts.seen).tolist():
                put("word", None, None, None, forms[i], int(counts.seen[i]))
            for key in counts.openings:
                put("opening", None, None, None, None, key - (1 << 64) if key >> 63 else key)
            counts.begin()

        def judge(value, h1, h2, core, mark, after):
            sentences = [u for u in _UNIT.split(core) if u and not u.isspace()]
            units = [counts.words.of(u) for u in sentences]
            last = units[-1] if units else []
            verdict, closed = _describe(core, mark, sentences, last, before, after)
            keys = None
            forms = counts.words.forms
            if verdict == "?":
                near = [forms[i] for i in last[-LENGTHS[-1] :]]
                keys = [k - (1 << 64) if k >> 63 else k for k in signatures(near, len(near) - 1, classes)]
                verdict = "?" + (" weak" if mark else "") + ("" if core[-1:].isalnum() else " other")
            put("value", h1, h2, verdict, forms[last[-1]] if last else "", int(closed), keys=keys)
            for unit in units[:-1]:
                if unit:
                    counts.add(unit)
            counts.others += last[:-1]
            counts.begun(last)
            if last and not closed and len(last) <= FORMULA:
                key = counts.opening(last)
                put("formula", h1, h2, verdict, None, key - (1 << 64) if key >> 63 else key)

        def edge(which):
            for value, h1, h2, _, _ in group:
                put("edge", h1, h2, which, value, 0)

        def pass_group(after):
            nonlocal before, groups
            for row in group:
                judge(*row, after)
            if groups < 2:  # the second shows what follows the first
                edge("first")
            groups += 1
            before = group[-1][0]
            group.clear()

        for batch in batches:
            for value, h1, h2 in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held == value:
                    continue
                core, mark = core_of(value)
                if group and group[-1][3] != core:
                    pass_group(value)
                group.append((value, h1, h2, core, mark))
                held = value
                if len(counts.ids) + len(counts.others) > PENDING:
                    count()
                    if len(counts.words.forms) + len(counts.openings) > KNOWN:
                        tell()
            yield flush()
        if group:
            if before is not None:
                put("edge", None, None, "last", before, 0)
            edge("last")
            pass_group(None)
        count()
        tell()
        yield flush()

    h1, h2 = _hashes(F.col("value"))
    ranged = values.select("value", h1.alias("h1"), h2.alias("h2")).repartitionByRange("value").sortWithinPartitions("value")
    seen = cut(ranged.mapInArrow(sorted_pass, "kind string, h1 long, h2 long, verdict string, word string, n long, keys array<long>"))

    # values of the first two and the last two cores of a partition are neighbours of those of the next
    edges = seen.filter("kind = 'edge'").select("word", "h1", "h2").collect()
    near = sorted({r["word"] for r in edges}, key=str.encode)
    cores = [core_of(v)[0] for v in near]
    own = {r["word"]: (r["h1"], r["h2"]) for r in edges if r["h1"] is not None}
    extra = []
    for i, (value, core) in enumerate(zip(near, cores)):
        if value in own and not _CLOSED.search(core):
            others = [next((near[j] for j in side if cores[j] != core), None) for side in (range(i + 1, len(near)), range(i - 1, -1, -1))]
            if any(continuation(core, other) == "cut" for other in others):
                extra.append(own[value])
    more = spark.createDataFrame(extra, "h1 long, h2 long")

    judged = _by_signature(seen)
    vocabulary = seen.filter("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n"))
    asked = judged.filter("verdict in ('', 'whole?', 'cut?')")
    # a last word is broken when it is a strict prefix of words that are far more frequent than it is whole; prefixes are
    # made of the lengths only that last words have, and meet as hashes
    last = asked.select("word").distinct().select("word", F.length("word").alias("k"), F.xxhash64("word").alias("h"))
    lengths = F.broadcast(last.agg(F.collect_set("k").alias("ks")))  # at most as many numbers as the longest word has letters
    shorter = F.filter("ks", lambda k: k < F.length("word"))
    prefixes = vocabulary.crossJoin(lengths).select(F.explode(F.transform(shorter, lambda k: F.struct(k.alias("k"), F.xxhash64(F.substring("word", F.lit(1), k)).alias("h")))).alias("p"), "n")
    longer = prefixes.groupBy("p.k", "p.h").agg(F.sum("n").alias("longer"))
    broken = last.join(longer, ["k", "h"]).join(vocabulary, "word", "left").filter(F.coalesce("n", F.lit(0)) * RARER <= F.col("longer"))
    by_word = asked.join(broken, "word", "left_semi").select("h1", "h2")
    # a short last unit that many values share and that begins nothing longer is a closing formula
    units = seen.filter("kind = 'formula'").select("h1", "h2", F.col("n").alias("key"))
    shared = units.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1")
    begun = seen.filter("kind = 'opening'").select(F.col("n").alias("key")).distinct()
    formulas = shared.join(begun, "key", "left_anti")
    spared = units.join(formulas, "key", "left_semi").select("h1", "h2")
    spared = spared.join(by_word, ["h1", "h2"], "left_anti")
    guessed = judged.filter("verdict = 'cut?'").select("h1", "h2").join(spared, ["h1", "h2"], "left_anti")
    known = judged.filter("verdict = 'cut'").select("h1", "h2")
    return known.unionByName(guessed).unionByName(by_word).unionByName(more).distinct()


def find_truncated(df: DataFrame, id_col: str, fields: Mapping[str, str]) -> DataFrame:
    """(id_col, field): the fields of each row whose value was cut. ``fields`` maps fields to their source columns.

    Null and blank values and values without a word are no cases. Complete values that lack closing punctuation
    or close in an unusual way are none either. Repeated rows count each. Texts are read whole, of any length.
    An empty table gives an empty result.
    """
    names = list(fields)
    long = df.select(
        F.col(f"`{id_col}`").alias("_id"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"`{n}`").alias("value")) for n in names])).alias("_v"),
    ).select("_id", "_v.field", "_v.value")
    long = long.filter(F.col("value").isNotNull() & (F.length("value") > 0))
    found = cut_values(long.select("value"))
    h1, h2 = _hashes(F.col("value"))
    rows = long.select("_id", "field", h1.alias("h1"), h2.alias("h2"))
    return rows.join(found, ["h1", "h2"], "left_semi").select(F.col("_id").alias(id_col), "field")


def truncation_rates(df: DataFrame, id_col: str, fields: Mapping[str, str], found: DataFrame | None = None) -> DataFrame:
    """(field, source, n_values, n_cut, share): how often each source truncates each field.

    ``n_values`` counts non-null, non-empty values. Null sources are one source.
    """
    found = find_truncated(df, id_col, fields) if found is None else found
    hits = found.groupBy(F.col(id_col).alias("_id"), "field").agg(F.count("*").alias("_hits"))
    out = None
    for field, source in fields.items():
        rows = df.filter(F.length(F.col(f"`{field}`")) > 0).select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source}`").cast("string").alias("source"))
        met = rows.join(hits.filter(F.col("field") == field), "_id", "left")
        rates = met.groupBy(F.lit(field).alias("field"), "source").agg(F.count("*").alias("n_values"), F.count("_hits").alias("n_cut"))
        out = rates if out is None else out.unionByName(rates)
    return out.withColumn("share", F.col("n_cut") / F.col("n_values"))
