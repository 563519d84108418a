"""Top N rows of every group by a secondary sort.

Rows are hash-partitioned by group and sorted inside each partition by (group, score, id); Arrow batches
then stream through one pass that counts places and keeps the first N, so that no group is ever buffered.
The same pass runs once before the shuffle on each input partition, so at most N rows per group and input
partition travel: a group holding a third of all rows costs its shuffle no more than any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCORE, _ID, _PLACE, _KEY, _ROW = "_top_score", "_top_id", "_top_place", "_top_key", "_top_row"


def _changes(column: pa.Array, last) -> np.ndarray:
    """True where a value differs from the one before it (``last`` before the first)."""
    out = np.ones(len(column), dtype=bool)
    if len(column) > 1:
        out[1:] = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
    out[0] = last is None or column[0].as_py() != last
    return out


def _keep_first(keys: Sequence[str], n: int):
    """A pass over sorted batches that keeps the first ``n`` rows of every run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        carried = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            columns = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            new = np.zeros(batch.num_rows, dtype=bool)
            for i, column in enumerate(columns):
                new |= _changes(column, None if last is None else last[i])
            at = np.arange(batch.num_rows)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start >= 0, at - start, at + carried)
            last = [c[-1].as_py() for c in columns]
            carried = int(place[-1]) + 1
            keep = place < n
            kept = batch.filter(pa.array(keep))
            where = kept.schema.get_field_index(_PLACE)
            yield kept.set_column(where, kept.schema.field(where), pa.array((place[keep] + 1).astype(np.int32)))

    return run


def top_n_per_group(
    df: DataFrame, groups: Sequence[str], score: str, id_col: str, n: int, place: str = "place"
) -> DataFrame:
    """The ``n`` rows of each group with the highest ``score``, the smaller ``id_col`` first among equals.

    Returns all columns of ``df`` plus ``place`` (1..n); a column of that name in ``df`` is replaced.
    Null, NaN and infinite scores get no place; rows with a null in any group column are in no group; a null
    id comes after all others of its score. Equal rows stay separate items. Scores 0.0 and -0.0 tie. An
    empty table gives an empty result. Group columns may be of any orderable type.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    value = F.col(f"`{score}`").cast("double")
    ok = value.isNotNull() & ~F.isnan(value) & ~value.isin(float("inf"), float("-inf"))
    for g in groups:
        ok = ok & F.col(f"`{g}`").isNotNull()
    rest = [c for c in df.columns if c != place]
    keys = [f"{_KEY}{i}" for i in range(len(groups))]
    rows = df.filter(ok).select(
        *[F.col(f"`{g}`").alias(k) for g, k in zip(groups, keys)],
        (value + F.lit(0.0)).alias(_SCORE),
        F.col(f"`{id_col}`").alias(_ID),
        F.lit(0).alias(_PLACE),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias(_ROW),
    )
    order = [*[F.col(k) for k in keys], F.col(_SCORE).desc(), F.col(_ID).asc_nulls_last()]
    step = _keep_first(keys, n)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema.fields])
    local = rows.sortWithinPartitions(*order).mapInArrow(step, schema)
    done = local.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*order).mapInArrow(step, schema)
    return done.select(*[F.col(_ROW)[c].alias(c) for c in rest], F.col(_PLACE).alias(place))
