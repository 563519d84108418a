"""Tokenizing a corpus through a table of its distinct words.

A byte-level BPE never merges across the words its pattern splits a text into, so each distinct word needs
encoding once. The split is Spark's ``regexp_extract_all``; counting the words is a group-by whose partial
step runs before the shuffle, so only distinct words travel. Ids come back by position:

* the most frequent words (at most ``head_words`` words and ``HEAD_BYTES`` bytes, whatever the corpus) are a
  broadcast Arrow table, and each batch looks its words up in it;
* all other words are joined by shuffle as (text hash, word) pairs and reach their texts as a short list;
* words of more than ``LONG`` characters hardly ever repeat, so each batch encodes its own, each once, and they never
  travel as keys.

All ways give the same ids; the limits move work between them and drop nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import util
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonewright.session import cut

#: Fixed value: the public split pattern of the byte-level BPE vocabularies of 50,000 pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Java needs the flag for Unicode white space.
_JAVA_PATTERN = "(?U)" + PATTERN
#: Most words of the broadcast part of the word table, and most bytes of their text.
HEAD_WORDS = 1_000_000
HEAD_BYTES = 48 << 20
#: Longest word of the table.
LONG = 64


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a vocabulary file: in ``folder``, else where the installed package of vocabularies keeps it."""
    if folder:
        return str(Path(folder) / name)
    found = util.find_spec("public_tokenizers")
    if found and found.origin:
        return str(Path(found.origin).parent / name)
    return str(Path("/opt/tokenizers") / name)


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, built once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines)}
        _ENCODERS[path] = tiktoken.Encoding(
            Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path]


def words_of(text: str = "text"):
    """Column of the words of a text, in order; an empty list for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(F.col(text), F.lit(_JAVA_PATTERN), F.lit(0)), F.array().cast("array<string>"))


def word_table(texts: DataFrame, text: str, path: str) -> DataFrame:
    """(word, n, ids): each distinct word of the corpus of up to LONG characters, its count and its ids, encoded once."""
    words = texts.select(F.explode(words_of(text)).alias("word")).filter(F.length("word") <= LONG)
    counts = words.groupBy("word").agg(F.count("*").alias("n"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids = [enc.encode_ordinary(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"]
            )

    return counts.mapInArrow(encode, "word string, n long, ids array<int>")


@dataclass
class WordTable:
    """A materialised word table: its broadcast head, and the rest as a DataFrame (None when empty)."""

    path: str
    head: object
    tail: DataFrame | None


def build_words(texts: DataFrame, text: str, path: str, head_words: int = HEAD_WORDS) -> WordTable:
    """Materialise the word table of a corpus and broadcast its most frequent words within the fixed bound."""
    spark = texts.sparkSession
    table = cut(word_table(texts, text, path))
    total, size = table.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    head_words = min(head_words, HEAD_BYTES * total // max(size, 1) if size > HEAD_BYTES else head_words)
    whole = total <= head_words
    head = (table if whole else table.orderBy(F.desc("n"), "word").limit(head_words)).select("word", "ids").toArrow()
    head = head.combine_chunks()
    tail = None if whole else table.join(spark.createDataFrame(head.select(["word"])), "word", "left_anti")
    return WordTable(path, spark.sparkContext.broadcast(head), tail)


def _array(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    if column.num_chunks == 0:
        return pa.array([], column.type)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


_HELD: list[tuple] = []


def head_arrays(head) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words, starts, lengths and flat ids of a broadcast head, laid out once for as long as a worker uses the same one.

    The head itself is kept beside its arrays, so that no later head can stand at its address.
    """
    if not _HELD or _HELD[0][0] is not head:
        words, ids = _array(head, "word"), _array(head, "ids")
        offsets = ids.offsets.to_numpy()
        _HELD[:] = [(head, words, offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64), ids.values.to_numpy())]
    return _HELD[0][1:]


def with_rare(df: DataFrame, text: str, table: WordTable, rare: str) -> DataFrame:
    """``df`` plus ``rare``: for each text the words of the table outside the broadcast head, with their ids.

    Null where a text has none. The list of one text is bounded by the text. Rows with equal texts share it.
    """
    kind = "array<struct<word:string,ids:array<int>>>"
    if table.tail is None:
        return df.withColumn(rare, F.lit(None).cast(kind))
    head = table.head

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head_arrays(head.value)[0]
        for batch in batches:
            words = batch.column(2)
            flat = words.flatten()
            row = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
            out = pc.and_(pc.is_null(pc.index_in(flat, known)), pc.less_equal(pc.utf8_length(flat), LONG)).to_numpy(zero_copy_only=False)
            rows = pa.array(row[out])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), flat.filter(pa.array(out))], names=["h1", "h2", "word"]
            )

    keys = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), F.col(text)).alias("h2")]
    wanted = (
        df.filter(F.length(text) > 0)
        .select(*keys, words_of(text).alias("words"))
        .mapInArrow(missing, "h1 long, h2 long, word string")
        .distinct()
    )
    lists = (
        wanted.join(table.tail.select("word", "ids"), "word")
        .groupBy("h1", "h2")
        .agg(F.collect_list(F.struct("word", "ids")).alias(rare))
    )
    keyed = df.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.xxhash64(F.lit(17), F.col(text)))
    return keyed.join(lists, (keyed["_h1"] == lists["h1"]) & (keyed["_h2"] == lists["h2"]), "left").drop("_h1", "_h2", "h1", "h2")


def look_up(words: pa.Array, rare: pa.Array, head: pa.Table, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the flattened ``words`` of a batch: start and length of each word's ids, and the flat ids."""
    known, starts, sizes, flat = head_arrays(head)
    values = words.flatten()
    at = pc.fill_null(pc.index_in(values, known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    rest = np.flatnonzero(at < 0)
    if not len(rest):
        return starts[at], sizes[at], flat
    left = values.take(pa.array(rest))
    # a rare word has the same ids in every text, so the lists of a batch can be used as one
    entries = rare.flatten() if len(rare) > rare.null_count else None
    more = entries.field("word") if entries is not None else pa.array([], pa.string())
    lists = entries.field("ids") if entries is not None else pa.array([], pa.list_(pa.int32()))
    unknown = left.filter(pc.is_null(pc.index_in(left, more))).unique()
    enc = encoder(path)
    own = [enc.encode_ordinary(w) for w in unknown.to_pylist()]
    offsets = lists.offsets.to_numpy()
    ends = np.cumsum([len(x) for x in own], dtype=np.int64)
    more_sizes = np.concatenate([np.diff(offsets).astype(np.int64), np.diff(ends, prepend=0)])
    more_starts = len(flat) + np.concatenate([offsets[:-1].astype(np.int64), len(lists.values) + ends - np.diff(ends, prepend=0)])
    new = np.fromiter((i for x in own for i in x), dtype=flat.dtype)
    # positions among the lists that came along, then among those encoded here
    second = pc.index_in(left, pa.concat_arrays([more.cast(pa.string()), unknown.cast(pa.string())])).to_numpy(zero_copy_only=False).astype(np.int64)
    out_starts, out_sizes = np.empty(len(at), dtype=np.int64), np.empty(len(at), dtype=np.int64)
    there = np.flatnonzero(at >= 0)
    out_starts[there], out_sizes[there] = starts[at[there]], sizes[at[there]]
    out_starts[rest], out_sizes[rest] = more_starts[second], more_sizes[second]
    return out_starts, out_sizes, np.concatenate([flat, lists.values.to_numpy(), new])


def ragged_take(starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Concatenation of the runs ``flat[s : s + n]``."""
    total = int(sizes.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(sizes)
    at = np.ones(total, dtype=np.int64)
    some = sizes > 0
    first = (ends - sizes)[some]
    run = starts[some]
    at[first[0]] = run[0]
    at[first[1:]] = run[1:] - (run[:-1] + sizes[some][:-1]) + 1
    return flat[np.cumsum(at)]


def encode_corpus(
    docs: DataFrame, id_col: str, text: str, path: str | None = None, ids: str = "ids", head_words: int = HEAD_WORDS
) -> DataFrame:
    """(id_col, ids): the ids of each row's text under the vocabulary at ``path``, without special tokens.

    One row per row of ``docs``, repeated and null ids included. Null and empty texts give an empty list. Texts
    are taken as they are, of any length; strings that look like special tokens are ordinary text. An empty
    table gives an empty result. Other columns are not read.
    """
    path = path or tokenizer_path()
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    table = build_words(source, "_text", path, head_words)
    head = table.head
    rows = with_rare(source, "_text", table, "_rare").select("_id", words_of("_text").alias("_words"), "_rare")

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            starts, sizes, flat = look_up(words, batch.column(2), head.value, path)
            out = ragged_take(starts, sizes, flat).astype(np.int32, copy=False)
            counts = np.concatenate([[0], np.cumsum(sizes)])
            offsets = counts[words.offsets.to_numpy() - words.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(out))],
                names=["_id", "_ids"],
            )

    schema = T.StructType(
        [T.StructField("_id", source.schema["_id"].dataType), T.StructField("_ids", T.ArrayType(T.IntegerType()))]
    )
    done = rows.mapInArrow(join_ids, schema)
    return done.select(F.col("_id").alias(id_col), F.col("_ids").alias(ids))


def decode_corpus(encoded: DataFrame, id_col: str, ids: str, path: str | None = None, text: str = "text") -> DataFrame:
    """(id_col, text): texts from ids, by joining each position with the id-to-piece table.

    The piece table has one row per id of the vocabulary (50,256), which bounds what is broadcast; each batch looks up
    all its positions in it, so rows neither move nor meet. A null list gives a null text, an empty one an empty text; a
    null id or one outside the vocabulary gives a null text; bytes that are no text become replacement characters. Repeated
    rows come back repeated, an empty table gives an empty result.
    """
    path = path or tokenizer_path()
    with open(path, "rb") as lines:
        pieces = {int(rank): base64.b64decode(piece) for piece, rank in (line.split() for line in lines)}
    spark = encoded.sparkSession
    table = spark.sparkContext.broadcast(pa.array([pieces.get(i) for i in range(max(pieces) + 1)], pa.binary()))
    rows = encoded.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{ids}`").cast("array<int>").alias("_ids"))

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: pa.Array = table.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column(1)
                flat = lists.flatten()
                ok = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(known)))
                found = known.take(pc.if_else(ok, flat, None))
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                at_byte = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
                missing = np.concatenate([[0], np.cumsum(found.is_null().to_numpy(zero_copy_only=False))])
                null = lists.is_null().to_numpy(zero_copy_only=False) | (missing[ends[1:]] > missing[ends[:-1]])
                data = found.buffers()[2]
                raw = memoryview(data) if data is not None else b""
                out = [None if n else str(raw[a:b], "utf-8", "replace") for n, a, b in zip(null.tolist(), at_byte[ends[:-1]].tolist(), at_byte[ends[1:]].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["_id", "_text"])

    schema = T.StructType([T.StructField("_id", rows.schema["_id"].dataType), T.StructField("_text", T.StringType())])
    done = rows.mapInArrow(join_pieces, schema)
    return done.select(F.col("_id").alias(id_col), F.col("_text").alias(text))


def token_sizes(
    docs: DataFrame, text: str, path: str | None = None, size: str = "n_tokens", head_words: int = HEAD_WORDS
) -> DataFrame:
    """``docs`` without its text, plus ``size``: the number of ids of each row's text (0 for null and empty ones).

    A column named ``size`` in ``docs`` is replaced.
    """
    path = path or tokenizer_path()
    rest = [c for c in docs.columns if c not in (text, size)]
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("_")).alias("_row"), F.col(f"`{text}`").alias("_text"))
    table = build_words(source, "_text", path, head_words)
    head = table.head
    rows = with_rare(source, "_text", table, "_rare").select("_row", words_of("_text").alias("_words"), "_rare")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            _, sizes, _ = look_up(words, batch.column(2), head.value, path)
            sums = np.concatenate([[0], np.cumsum(sizes)])
            at = words.offsets.to_numpy() - words.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(sums[at]))], names=["_row", "_n"])

    schema = T.StructType([T.StructField("_row", source.schema["_row"].dataType), T.StructField("_n", T.LongType())])
    done = rows.mapInArrow(add_up, schema)
    return done.select(*[F.col("_row")[c].alias(c) for c in rest], F.col("_n").alias(size))
