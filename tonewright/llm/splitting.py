"""Splitting oversized texts at natural boundaries, into pieces of balanced length.

For each text the least number of pieces is computed, equal-length targets are placed, each is snapped to the
strongest boundary near it, and pieces are added when any limit fails: the text starts again with as many more as the
rest was found to need. After ``TRIES`` such starts a text keeps what it has, and the targets of the rest are placed
anew from there, which always ends.

Token counts come from the word table, so a text is counted once for all settings and a piece is a difference of running
sums; only its first word, which loses its leading space, is counted again. All texts of a batch are cut side by side: one
step places the next piece of each, by binary searches over the boundaries of all texts.

A word beyond the limit is cut where its own tokens end, if a character ends there too. Pieces of such texts are
encoded again; a text with a piece above the limit is cut once more under a lower one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewright.llm.tokens import HEAD_WORDS, build_words, encoder, look_up, tokenizer_path, with_rare, words_of

#: Strength of the boundary before a word, from none to an empty line.
INSIDE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
#: Most rows of the table of settings, which is read by the driver.
MOST_SETTINGS = 1000
#: Starts of a text with more pieces before the rest is placed anew from where it stands.
TRIES = 4
#: Words whose texts are cut side by side (a longer text stands alone).
TOGETHER = 1_000_000
_PLACE = (1 << 40) - 1


def _kinds(words: pa.Array) -> dict[str, np.ndarray]:
    """What each distinct word says about the boundaries beside it."""
    has = lambda pattern: pc.match_substring_regex(words, pattern).to_numpy(zero_copy_only=False)
    second = pc.utf8_slice_codeunits(words, 1, 2)
    first = pc.utf8_slice_codeunits(words, 0, 1)
    space = pc.utf8_is_space(words).to_numpy(zero_copy_only=False)
    leading = pc.utf8_is_space(first).to_numpy(zero_copy_only=False)
    lower = np.where(
        leading, pc.utf8_is_lower(second).to_numpy(zero_copy_only=False), pc.utf8_is_lower(first).to_numpy(zero_copy_only=False)
    )
    return {
        "space": space,
        "leading": leading,
        "lower": lower.astype(bool),
        "lines": pc.count_substring_regex(words, r"\r\n|\r|\n").to_numpy(zero_copy_only=False),
        "sentence": has(r"^ ?[^\p{L}\p{N}]*[.!?…。！？][^\p{L}\p{N},;:—–-]*$") & ~space,
        "clause": has(r"[,;:—–)»”]$") | has(r"^ ?-+$"),
        "quote": has(r"^ ?['’]"),
        "chars": pc.utf8_length(words).to_numpy(zero_copy_only=False),
    }


def strengths(forms: pa.Array, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """For words given by their distinct forms and codes: the strength of the boundary before each, its characters and
    white space; and what is known of the forms.

    The boundary before the first word of a text counts nowhere.
    """
    of_form = _kinds(forms)
    kinds = {k: v[code] for k, v in of_form.items()}
    n = len(code)
    out = np.full(n, INSIDE, dtype=np.int8)
    if n > 1:
        prev = {k: np.concatenate([v[:1], v[:-1]]) for k, v in kinds.items()}
        spaced = (kinds["leading"] | prev["space"]) & ~kinds["space"]
        # a punctuation word before white space that is a word of its own
        before = {k: np.where(prev["space"], np.concatenate([v[:1], v[:1], v[:-2]]), prev[k]) for k, v in kinds.items()}
        lines = np.where(prev["space"], prev["lines"] + np.where(before["space"], before["lines"], 0), 0)
        out[spaced] = WORD
        out[spaced & before["clause"]] = CLAUSE
        out[spaced & before["sentence"]] = np.where(kinds["lower"], CLAUSE, SENTENCE)[spaced & before["sentence"]]
        out[spaced & (lines == 1)] = LINE
        out[spaced & (lines > 1)] = PARAGRAPH
        out[kinds["quote"]] = INSIDE  # a quote mark at the start of a piece would be split another way
    return out, kinds["chars"].astype(np.int64), kinds["space"].astype(bool), of_form


class _Counter:
    """Token counts of short strings, remembered within bounds."""

    def __init__(self, enc):
        self.enc, self.known = enc, {}
        self.lengths: np.ndarray | None = None

    def __call__(self, text: str) -> int:
        got = self.known.get(text)
        if got is None:
            got = len(self.enc.encode_ordinary(text))
            if len(text) <= 64:
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[text] = got
        return got

    def runs(self, word: str, most: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of the runs of a word that end with one of its tokens; single characters where a run has
        more than ``most`` tokens. A character of more than ``limit`` tokens is an error."""
        if self.lengths is None:
            self.lengths = np.zeros(self.enc.n_vocab, dtype=np.int64)
            self.lengths[:] = [len(t) for t in self.enc.decode_tokens_bytes(range(self.enc.n_vocab))]
        ends = np.cumsum(self.lengths[self.enc.encode_ordinary(word)])
        begins = np.append(np.frombuffer(word.encode(), np.uint8) & 0xC0 != 0x80, True)  # of characters, and the end
        last = np.flatnonzero(begins[ends])
        n_tokens = np.diff(last, prepend=-1)
        n_chars = np.diff(np.concatenate([[0], np.cumsum(begins)])[ends[last]], prepend=0)
        if n_tokens.max() > most:
            at, out = 0, []
            for chars, tokens in zip(n_chars.tolist(), n_tokens.tolist()):
                out += [(chars, tokens)] if tokens <= most else [(1, self(c)) for c in word[at : at + chars]]
                at += chars
            n_chars, n_tokens = (np.array(x, dtype=np.int64) for x in zip(*out))
            if n_tokens.max() > limit:
                raise ValueError(f"a character has more than {limit} tokens")
        return n_chars, n_tokens


class _Words:
    """The words of several texts behind each other: running sums of tokens and characters, boundaries and ends."""

    def __init__(self, sizes, chars, strength, space, leading, code, offsets, forms: pa.Array, counted: _Counter):
        self.offsets, self.space, self.leading, self.code = offsets, space, leading & ~space, code
        self.forms, self.counted, self.changes = forms, counted, np.full(len(forms) + 1, -(1 << 30), dtype=np.int64)
        self.changes[-1] = 0  # a run of a word, whose pieces are encoded again
        n = len(sizes)
        self.tokens = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(chars)]).astype(np.int64)
        here = np.arange(n + 1)
        full = np.concatenate([~space, [True]])
        self.next_full = np.minimum.accumulate(np.where(full, here, n)[::-1])[::-1]
        self.past_full = np.maximum.accumulate(np.concatenate([[0], np.where(~space, here[1:], 0)]))
        level = np.append(strength, INSIDE).astype(np.int8)
        level[offsets[:-1]] = INSIDE
        # the strongest boundary of 2 ** k words from each word on, and all boundaries by strength and place
        self.strongest = [level]
        while 2 << len(self.strongest) <= n + 1:
            half, top = 1 << (len(self.strongest) - 1), self.strongest[-1]
            self.strongest.append(np.maximum(top[:-half], top[half:]) if len(top) > half else top)
        self.by_level = np.sort(level.astype(np.int64) << 40 | here)

    def change(self, at: np.ndarray) -> np.ndarray:
        """How many tokens words gain when they lose their leading space."""
        code = np.where(self.leading[at], self.code[at], -1)
        new = np.unique(code[self.changes[code] == -(1 << 30)])
        for c, word in zip(new.tolist(), self.forms.take(pa.array(new)).to_pylist()):
            self.changes[c] = self.counted(word[1:]) - self.counted(word)
        return self.changes[code]

    def snap(self, want, low, high, after, last) -> np.ndarray:
        """For each row the strongest boundary with a token position in [low, high], the nearest to ``want`` among equals;
        without one, the last word up to ``high``. Boundaries lie in [after, last]."""
        # whole numbers, as a search for others would copy the running sums
        a = np.maximum(np.searchsorted(self.tokens, np.ceil(low).astype(np.int64)), after)
        b = np.minimum(np.searchsorted(self.tokens, np.floor(high).astype(np.int64), "right") - 1, last)
        out = np.maximum(b, after)
        some = np.flatnonzero(a < b)
        if not len(some):
            return out
        a, b, want = a[some], b[some], want[some]
        k = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        level = np.empty(len(some), dtype=np.int64)
        for power in np.unique(k).tolist():
            of = k == power
            top = self.strongest[power]
            level[of] = np.maximum(top[a[of]], top[b[of] - (1 << power) + 1])
        at = np.searchsorted(self.by_level, level << 40 | np.searchsorted(self.tokens, np.ceil(want).astype(np.int64)))
        right, left = self.by_level[np.minimum(at, len(self.by_level) - 1)], self.by_level[np.maximum(at - 1, 0)]
        r_ok, l_ok = (right >> 40 == level) & (right & _PLACE <= b), (left >> 40 == level) & (left & _PLACE >= a)
        right, left = right & _PLACE, left & _PLACE
        nearer = l_ok & (~r_ok | (want - self.tokens[left] <= self.tokens[right] - want))
        out[some] = np.where(nearer, left, right)
        return out


def place(w: _Words, text: np.ndarray, most: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(job, first word, end word, tokens, balanced) of the pieces of all jobs, by job and place.

    A job is a ``text`` with its limit ``most`` and its ``overlap``.
    """
    tokens, share = w.tokens, most - overlap
    first, last = w.next_full[w.offsets[:-1][text]], w.past_full[w.offsets[1:][text]]
    whole = tokens[last]
    start, base, seen = first.copy(), tokens[first], first.copy()
    pieces = np.maximum(1, -(-(whole - base - overlap) // share))
    done, tries, anew = np.zeros_like(first), np.zeros_like(first), np.zeros(len(first), dtype=bool)
    open_ = np.flatnonzero(first < last)
    found = []
    while len(open_):
        t = open_
        done[t] += 1
        s, end_of = start[t], last[t]
        gain = w.change(s)
        cap = tokens[s] + most[t] - np.maximum(gain, 0)
        step = (whole[t] - base[t] - overlap[t]) / pieces[t]
        target = base[t] + overlap[t] + done[t] * step
        top = np.minimum(target + step / 4, cap)
        want = np.minimum(target, top)
        after = np.maximum(s, seen[t]) + 1
        final = done[t] >= pieces[t]
        end = np.where(final, end_of, w.snap(want, want - step / 4, top, after, end_of))
        # pieces that the rest needs beyond those that are left
        lack = -(-(whole[t] - tokens[end]) // share[t]) - (pieces[t] - done[t])
        over = final & (tokens[end_of] > cap) & (end_of > after)
        lack = np.where(over, np.maximum(2, -(-(whole[t] - tokens[s] - overlap[t]) // share[t])) - 1, np.where(final | anew[t], 0, lack))
        bad = lack > 0
        if bad.any():
            b = t[bad]
            again = tries[b] < TRIES
            r, keep = b[again], b[~again]
            anew[keep] = True
            pieces[r] += np.maximum(lack[bad][again], pieces[r] >> 4)
            pieces[keep] = np.maximum(2, -(-(whole[keep] - tokens[start[keep]] - overlap[keep]) // share[keep]))
            start[r] = seen[r] = first[r]
            base[b] = tokens[start[b]]
            done[b] = 0
            tries[b] += 1
        good = ~bad
        t, s, end, gain, end_of = t[good], s[good], end[good], gain[good], end_of[good]
        past = w.past_full[end]
        found.append((t, s, past, tokens[past] - tokens[s] + gain, tries[t]))
        more = end < end_of
        t, s, end, end_of = t[more], s[more], end[more], end_of[more]
        fresh = w.next_full[end]
        begin = fresh.copy()
        some = np.flatnonzero(overlap[t])
        if len(some):
            e, a, over = end[some], s[some] + 1, overlap[t[some]]
            back = tokens[e] - over
            at = w.next_full[np.clip(w.snap(back, back - over / 2, back + over / 2, a, e), a, e)]
            # an overlap that leaves no room for the next word is given up
            full = tokens[fresh[some] + 1] - tokens[at] + np.maximum(w.change(at), 0) > most[t[some]]
            begin[some] = np.where(full, begin[some], at)
        start[t], seen[t] = begin, fresh
        open_ = np.concatenate([t, open_[bad]])
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    t, s, e, n, tried = (np.concatenate(x) for x in zip(*found))
    # pieces of a start that was given up are those of fewer tries, unless the text went on from there
    since = np.where(anew, TRIES, tries)
    kept = np.where(anew[t], tried >= TRIES, tried == since[t])
    t, s, e, n = t[kept], s[kept], e[kept], n[kept]
    order = np.lexsort((s, t))
    t = t[order]
    return t, s[order], e[order], n[order], ~anew[t]


def _cut_long(sizes, chars, strength, space, leading, code, offsets, word_of: Callable[[int], str], counted, most, limit):
    """The words beyond ``most`` tokens as runs; also whether each text has any."""
    long = np.flatnonzero(sizes > most)
    touched = np.zeros(len(offsets) - 1, dtype=bool)
    if not len(long):
        return sizes, chars, strength, space, leading, code, offsets, touched
    touched[np.searchsorted(offsets, long, "right") - 1] = True
    times = np.ones(len(sizes), dtype=np.int64)
    cuts = []
    for i in long.tolist():
        word = word_of(i)
        n_chars, n_tokens = counted.runs(word, most, limit)
        at = np.concatenate([[0], np.cumsum(n_chars)]).tolist()
        blank = [word[a:b].isspace() for a, b in zip(at, at[1:])] if word[0].isspace() else np.zeros(len(n_chars), dtype=bool)
        cuts.append((n_chars, n_tokens, blank))
        times[i] = len(n_chars)
    begin = np.concatenate([[0], np.cumsum(times)])
    sizes, chars, strength, space, leading, code = (np.repeat(x, times) for x in (sizes, chars, strength, space, leading, code))
    for i, (n_chars, n_tokens, blank) in zip(long.tolist(), cuts):
        a, b = begin[i], begin[i + 1]
        sizes[a:b], chars[a:b], space[a:b], code[a:b] = n_tokens, n_chars, blank, -1
        strength[a + 1 : b], leading[a + 1 : b] = INSIDE, False
    return sizes, chars, strength, space, leading, code, begin[offsets], touched


class Cutter:
    """Cuts the texts of a batch for one setting after another."""

    def __init__(self, counted: _Counter, words: pa.Array, sizes: np.ndarray, offsets: np.ndarray):
        coded = words.dictionary_encode()
        self.forms, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.strength, self.chars, self.space, self.kinds = strengths(self.forms, self.code)
        self.sizes, self.offsets, self.counted = sizes, offsets, counted
        self.totals = np.diff(np.concatenate([[0], np.cumsum(sizes)])[offsets])

    def cut(self, jobs: list[tuple[int, int, int]], text_of: Callable[[int], str]) -> Iterator[tuple]:
        """(job, start, end, tokens, balanced) of the pieces of ``jobs`` (row, limit, overlap), in order of job and place."""
        rows, job_row = np.unique(np.array([j[0] for j in jobs], dtype=np.int64), return_inverse=True)
        longest = np.array([self.sizes[self.offsets[r] : self.offsets[r + 1]].max(initial=0) for r in rows.tolist()], dtype=np.int64)
        most, overlap = (np.array([j[i] for j in jobs], dtype=np.int64) for i in (1, 2))
        plain = longest[job_row] <= most
        groups = [(np.flatnonzero(plain), None)] + [(np.flatnonzero(~plain & (most == m)), int(m)) for m in np.unique(most[~plain])]
        for at, cap in groups:
            if len(at):
                some, row = np.unique(job_row[at], return_inverse=True)
                yield from self._some(rows[some], at, row, most[at], overlap[at], cap, text_of)

    def _some(self, rows, job, text, most, overlap, cap: int | None, text_of) -> Iterator[tuple]:
        """The pieces of jobs on ``rows``; with ``cap``, of jobs of one limit, whose words and pieces are held to ``cap``."""
        counts = np.diff(self.offsets)[rows]
        which = np.concatenate([[0], np.cumsum(counts)])
        index = np.repeat(self.offsets[:-1][rows] - which[:-1], counts) + np.arange(which[-1])
        code = self.code[index]
        parts = [self.sizes[index].astype(np.int64), self.chars[index], self.strength[index], self.space[index], self.kinds["leading"][code], code]
        long = np.zeros(len(rows), dtype=bool)
        if cap is not None:
            word_of = lambda i: self.forms[int(code[i])].as_py()
            *parts, which, long = _cut_long(*parts, which, word_of, self.counted, cap, int(most[0]))
        w = _Words(*parts, which, self.forms, self.counted)
        held = most if cap is None else np.full(len(job), cap)
        t, s, e, n, balanced = place(w, text, held, np.minimum(overlap, (held - 1) // 2))
        origin = w.at[w.offsets[:-1]][text[t]]
        begin, end = w.at[s] + w.leading[s] - origin, w.at[e] - origin
        # a piece is encoded again where its tokens may not be those of its words
        doubtful = (w.code[s] >= 0) & self.kinds["quote"][w.code[s]] | long[text[t]]
        edges = np.searchsorted(t, np.arange(len(job) + 1)).tolist()
        begin, end, n, balanced = begin.tolist(), end.tolist(), n.tolist(), balanced.tolist()
        doubts = np.flatnonzero(doubtful)
        for k in doubts.tolist():
            n[k] = len(self.counted.enc.encode_ordinary(text_of(int(rows[text[t[k]]]))[begin[k] : end[k]]))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a == b:
                continue
            limit = int(most[i])
            now = limit if cap is None else cap
            if max(n[a:b]) > limit and now > 1:
                lower = max(1, now - max(1, 2 * (limit - now)))
                yield from self._some(rows[text[i]][None], job[i : i + 1], np.zeros(1, np.int64), most[i : i + 1], overlap[i : i + 1], lower, text_of)
            else:
                yield int(job[i]), begin[a:b], end[a:b], n[a:b], balanced[a] and now == limit


def split_oversized(
    docs: DataFrame, limits: DataFrame, id_col: str, text: str, path: str | None = None, head_words: int = HEAD_WORDS
) -> DataFrame:
    """Cut every text with more than ``max_tokens`` tokens, for each setting of ``limits``.

    ``limits`` has (setting, max_tokens, overlap_tokens). Returns (setting, id_col, piece_no, n_pieces, start,
    end, n_tokens, balanced, piece): ``start`` and ``end`` are code points of the text, ``n_tokens`` the ids of the piece
    encoded on its own, never above the limit; ``balanced`` is false where the targets of a text had to be placed anew or its
    limit lowered. Pieces carry no outer white space and together cover all else;
    each shares about ``overlap_tokens`` tokens with the one before. Cuts fall on empty lines, line ends, sentence
    ends, clauses or words, in this order of preference near each target, and inside a word only when a word alone
    breaks the limit. Null, empty and blank texts and texts within the limit give no rows. Repeated rows give
    repeated pieces. An overlap is held below half of the limit; a setting with a null or limits under 1 is an
    error, and so is a character of more tokens than the limit, which only limits under 4 can meet.
    """
    path = path or tokenizer_path()
    settings = [(r[0], r[1], r[2]) for r in limits.select("setting", "max_tokens", "overlap_tokens").limit(MOST_SETTINGS + 1).collect()]
    if len(settings) > MOST_SETTINGS or any(m is None or o is None or m < 1 or o < 0 for _, m, o in settings):
        raise ValueError(f"limits need 1 to {MOST_SETTINGS} settings, each with max_tokens >= 1 and overlap_tokens >= 0")
    settings = [(s, int(m), min(int(o), (int(m) - 1) // 2)) for s, m, o in settings]
    least = min((m for _, m, _ in settings), default=1 << 60)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    table = build_words(source, "_text", path, head_words)
    head = table.head
    # a token has at least one byte, so shorter texts need not travel
    rows = with_rare(source.filter(F.octet_length("_text") > least), "_text", table, "_rare").select("_id", "_text", words_of("_text").alias("_words"), "_rare")
    out = pa.schema(
        [("setting", pa.string()), ("_row", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("start", pa.int64()),
         ("end", pa.int64()), ("n_tokens", pa.int32()), ("balanced", pa.bool_()), ("piece", pa.string())]
    )

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = _Counter(encoder(path))
        for batch in batches:
            offsets = batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + TOGETHER, "right")) - 1)
                yield from cut_some(batch.slice(at, to - at), counted)
                at = to

    def cut_some(batch: pa.RecordBatch, counted: _Counter) -> Iterator[pa.RecordBatch]:
        words = batch.column(2)
        _, sizes, _ = look_up(words, batch.column(3), head.value, path)
        cutter = Cutter(counted, words.flatten(), sizes, (words.offsets.to_numpy() - words.offsets[0].as_py()).astype(np.int64))
        texts: dict[int, str] = {}

        def text_of(row: int) -> str:
            if row not in texts:
                texts[row] = batch.column(1)[row].as_py()
            return texts[row]

        found: dict[str, list] = {name: [] for name in out.names}
        which = [(name, row, most, overlap) for name, most, overlap in settings for row in np.flatnonzero(cutter.totals > most).tolist()]
        for job, starts, ends, tokens, balanced in cutter.cut([x[1:] for x in which], text_of):
            (name, row, _, _), n = which[job], len(starts)
            text = text_of(row)
            found["setting"] += [name] * n
            found["_row"] += [row] * n
            found["piece_no"] += range(1, n + 1)
            found["n_pieces"] += [n] * n
            found["start"] += starts
            found["end"] += ends
            found["n_tokens"] += tokens
            found["balanced"] += [balanced] * n
            found["piece"] += [text[a:b] for a, b in zip(starts, ends)]
        done = pa.Table.from_pydict(found, schema=out)
        ids = batch.column(0).take(done.column("_row").combine_chunks())
        yield from done.set_column(1, "_id", ids).combine_chunks().to_batches()

    schema = T.StructType(
        [T.StructField("setting", T.StringType()), T.StructField("_id", source.schema["_id"].dataType),
         T.StructField("piece_no", T.IntegerType()), T.StructField("n_pieces", T.IntegerType()), T.StructField("start", T.LongType()),
         T.StructField("end", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("balanced", T.BooleanType()),
         T.StructField("piece", T.StringType())]
    )
    return rows.mapInArrow(cut_all, schema).withColumnRenamed("_id", id_col)
