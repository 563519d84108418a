"""Most similar vectors by a forest of random-projection trees.

A tree splits the collection at the median of one random projection a level, down to leaves of about
``leaf`` vectors. Directions are shared by the nodes of a level, so one product of a batch with all directions
gives every margin of every tree. A vector visits leaves in the order of one priority queue shared by all
trees: its own leaf of each tree first, then the branches it left by the smallest margin, whatever their tree. The queue of
all rows of a batch is worked level by level: as a branch never comes before its node, keeping at each level the
``count`` first nodes of all trees gives the leaves that the queue gives.

Rows of a leaf meet in one place and are compared by matrix product. ``similar_pairs`` sends codes of four bits a
dimension there and reranks what may reach the limit with the full vectors; ``nearest`` sends the full vectors and ranks them
where they meet. How many leaves ``nearest`` visits is measured on the collection: for at most ``ASKED`` of the asking rows
the true neighbours are found by brute force, and the least number of visits that reaches the wanted recall is taken.

Medians are fitted on the driver with at most ``SAMPLE`` vectors, taken by hash, as deep as these allow; deeper levels are
fitted by an aggregation over the collection. Every vector is indexed. A leaf with more than ``BLOCK`` index rows or
``PART`` asking rows, as many equal vectors make, is met in blocks and parts: each block with each part, so no task holds
a whole hot leaf. Asking rows stream past their block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tonewright.session import cut

#: Most vectors on which the trees are fitted; least sample of a leaf, which limits the depth.
SAMPLE = 1 << 16
SAMPLE_OF_LEAF = 8
#: Most index rows and most asking rows of a leaf that meet in one place.
BLOCK, PART = 1 << 14, 1 << 16
#: Rows of a product.
TILE = 512
#: Most asking rows whose recall is measured.
ASKED = 512


def unit_vectors(df: DataFrame, id_col: str, vector: str, dim: int, id_out: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, unit): usable vectors scaled to norm 1, as ``dim`` little-endian float32 values.

    Usable means exactly ``dim`` finite values, not all zero. Null vectors, null elements and rows with a null
    id are left out.
    """
    rows = df.select(F.col(f"`{id_col}`").alias(id_out), *[F.col(f"`{k}`").alias(k) for k in keep], F.col(f"`{vector}`").cast("array<float>").alias("_v"))
    rows = rows.filter(F.col(id_out).isNotNull() & (F.size("_v") == dim))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]] + ["unit binary"])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            ok = np.isfinite(values).all(1) & (values != 0).any(1)
            values = values[ok]
            values /= np.abs(values).max(1, keepdims=True)
            values /= np.sqrt((values * values).sum(1, keepdims=True))
            units = _binary(values.astype("<f4"))
            kept = batch.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], units], names=[*kept.schema.names[:-1], "unit"])

    return rows.mapInArrow(scale, schema)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of an array as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Binary values of equal length as the rows of an array."""
    if len(column) == 0:
        return np.zeros((0, width), dtype=dtype)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), width)


def encode(units: np.ndarray, bits: int) -> np.ndarray:
    """Codes of ``bits`` (4 or 8) a dimension behind each vector's scale; the vectors themselves for 32."""
    if bits == 32:
        return np.ascontiguousarray(units).view(np.uint8).reshape(len(units), -1)
    most = (1 << (bits - 1)) - 1
    scale = np.abs(units).max(1, keepdims=True) / most
    codes = np.rint(units / scale).astype(np.int8)
    if bits == 4:
        low = (codes + 8).astype(np.uint8)
        codes = (low[:, 0::2] | (low[:, 1::2] << 4)).view(np.int8)
    return np.concatenate([scale.astype("<f4").view(np.uint8), codes.view(np.uint8)], axis=1)


def decode(codes: np.ndarray, bits: int) -> np.ndarray:
    """Vectors from codes."""
    if bits == 32:
        return np.ascontiguousarray(codes).view("<f4")
    scale = np.ascontiguousarray(codes[:, :4]).view("<f4")
    body = codes[:, 4:]
    if bits == 4:
        out = np.empty((len(body), body.shape[1] * 2), dtype=np.float32)
        out[:, 0::2] = body & 15
        out[:, 1::2] = body >> 4
        out -= 8
    else:
        out = body.view(np.int8).astype(np.float32)
    return out * scale


@dataclass
class Forest:
    """Directions (trees, depth, dim) and thresholds (trees, nodes in heap order)."""

    directions: np.ndarray
    thresholds: np.ndarray

    @property
    def leaves(self) -> int:
        return self.thresholds.shape[1] + 1

    def visits(self, units: np.ndarray, count: int) -> np.ndarray:
        """(rows, count) leaves, numbered through all trees, in the order of the shared queue; a row's own leaves come first."""
        at = max(64, (1 << 21) // count)
        if len(units) > at:
            return np.concatenate([self.visits(units[i : i + at], count) for i in range(0, len(units), at)])
        trees, depth, dim = self.directions.shape
        n = len(units)
        margins = (units @ self.directions.reshape(-1, dim).T).reshape(n, trees, depth)
        node, cost = np.zeros((n, trees), dtype=np.int64), np.full((n, trees), -1, dtype=np.float32)
        tree = np.broadcast_to(np.arange(trees), (n, trees))
        for d in range(depth):
            m = margins[np.arange(n)[:, None], tree, d] - self.thresholds[tree, (1 << d) - 1 + node]
            near = 2 * node + (m >= 0)
            node = np.concatenate([near, near ^ 1], axis=1)
            cost = np.concatenate([cost, np.maximum(cost, np.abs(m))], axis=1)
            tree = np.concatenate([tree, tree], axis=1)
            if node.shape[1] > count:
                kept = np.argpartition(cost, count - 1, axis=1)[:, :count]
                node, cost, tree = (np.take_along_axis(x, kept, axis=1) for x in (node, cost, tree))
        order = np.argsort(cost, axis=1, kind="stable")
        return np.take_along_axis(tree.astype(np.int64) * self.leaves + node, order, axis=1)


def fit(sample: np.ndarray, trees: int, depth: int, seed: int) -> Forest:
    """Random directions and the medians of a sample along them."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    directions = rng.standard_normal((trees, depth, dim)).astype(np.float32)
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    thresholds = np.zeros((trees, (1 << depth) - 1), dtype=np.float32)
    for t in range(trees):
        along = sample @ directions[t].T
        node = np.zeros(len(sample), dtype=np.int64)
        for d in range(depth):
            order = np.lexsort((along[:, d], node))
            sorted_node = node[order]
            begin = np.searchsorted(sorted_node, np.arange(1 << d))
            end = np.searchsorted(sorted_node, np.arange(1 << d), "right")
            value = along[order, d]
            middle = np.where(end > begin, value[np.minimum((begin + end) // 2, len(sample) - 1)], 0.0)
            thresholds[t, (1 << d) - 1 : (1 << (d + 1)) - 1] = middle
            node = 2 * node + (along[:, d] >= middle[node])
    return Forest(directions, thresholds)


def _depth(rows: int, leaf: int) -> int:
    return max(0, round(float(np.log2(max(rows, 1) / leaf))))


def _sample(vectors: DataFrame, rows: int, dim: int, most: int) -> np.ndarray:
    """At most ``most`` vectors, those of the smallest hashes of a thinned collection."""
    thin = max(1, rows // (2 * most))
    some = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(thin)) == 0).orderBy(F.xxhash64(F.lit(3), F.col("id")), "id").limit(most)
    return _column(some, dim)


def _column(units: DataFrame, dim: int) -> np.ndarray:
    got = units.select("unit").toArrow().column(0).combine_chunks()
    return _matrix(got if isinstance(got, pa.Array) else pa.concat_arrays(got.chunks), "<f4", dim)


def _deepened(vectors: DataFrame, rows: int, forest: Forest, dim: int) -> Forest:
    """``forest`` with one more level below its leaves: medians of about 64 vectors a leaf, by an aggregation."""
    spark, trees = vectors.sparkSession, forest.directions.shape[0]
    depth = forest.directions.shape[1] - 1  # the directions of the new level are there, its thresholds are not
    upper = spark.sparkContext.broadcast(Forest(forest.directions[:, :depth], forest.thresholds))
    along = spark.sparkContext.broadcast(forest.directions[:, depth])

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _matrix(batch.column(0), "<f4", dim)
            leaf = np.sort(upper.value.visits(units, trees), axis=1)
            m = units @ along.value.T
            yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel()), pa.array(m.astype(np.float32).ravel())], names=["leaf", "m"])

    thin = max(1, rows // (64 << depth))
    some = vectors.filter(F.pmod(F.xxhash64(F.lit(5), F.col("id")), F.lit(thin)) == 0)
    found = some.select("unit").mapInArrow(margins, "leaf long, m float").groupBy("leaf").agg(F.percentile_approx("m", 0.5, 100).alias("m")).toArrow()
    new = np.zeros(trees << depth, dtype=np.float32)
    new[found.column("leaf").to_numpy()] = found.column("m").to_numpy()
    return Forest(forest.directions, np.concatenate([forest.thresholds, new.reshape(trees, -1)], axis=1))


#: A row's place: leaf, block and part of the leaf, and role in one number. Role 0 is asked, 2 asks, 1 does both.
_ROLE_BITS, _PART_BITS, _BLOCK_BITS = 2, 14, 20
_LEAF_SHIFT = _ROLE_BITS + _PART_BITS + _BLOCK_BITS


def _placed(vectors: DataFrame, forest, dim: int, bits: int | None, visits: int, queries: str | None) -> DataFrame:
    """(key, id, code): every row in its own leaf of each tree, rows that ask also in their further visits.

    Without ``bits`` only the keys come out.
    """
    trees = forest.value.directions.shape[0]
    columns = ["id", "unit"] + ([queries] if queries else [])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = forest.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                units = _matrix(batch.column(1), "<f4", dim)
                n = len(units)
                asks = np.ones(n, dtype=bool) if queries is None else batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if asks.all():
                    all_leaves = f.visits(units, visits)
                    own, more = all_leaves[:, :trees], all_leaves[:, trees:]
                else:
                    own, more = f.visits(units, trees), f.visits(units[asks], visits)[:, trees:]
                row = np.concatenate([np.repeat(np.arange(n), own.shape[1]), np.repeat(np.flatnonzero(asks), more.shape[1])])
                role = np.concatenate([np.repeat(asks.astype(np.int64), own.shape[1]), np.full(more.size, 2)])
                key = pa.array((np.concatenate([own.ravel(), more.ravel()]) << _LEAF_SHIFT) | role)
                if bits is None:
                    yield pa.RecordBatch.from_arrays([key], names=["key"])
                else:
                    ids = batch.column(0).to_numpy(zero_copy_only=False)[row]
                    yield pa.RecordBatch.from_arrays([key, pa.array(ids), _binary(encode(units, bits)[row])], names=["key", "id", "code"])

    return vectors.select(*columns).mapInArrow(place, "key long" + (", id long, code binary" if bits else ""))


def _split(placed: DataFrame, keys: DataFrame) -> DataFrame:
    """``placed`` with the leaves beyond BLOCK index rows or PART asking rows in several places, by the ``keys`` of all."""
    leaf, role = F.shiftright("key", _LEAF_SHIFT), F.col("key").bitwiseAND(3)
    full = keys.groupBy(leaf.alias("leaf")).agg(
        F.ceil(F.count_if(role < 2) / BLOCK).cast("long").alias("blocks"), F.ceil(F.count_if(role > 0) / PART).cast("long").alias("parts")
    )
    full = cut(full.filter("blocks > 1 or parts > 1"))  # a few rows: at most rows x trees / BLOCK
    if full.isEmpty():
        return placed
    joined = placed.withColumn("leaf", leaf).join(full, "leaf", "left")
    joined = joined.withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1).cast("long")) for c in ("blocks", "parts")})
    joined = joined.withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("p", F.pmod(F.xxhash64(F.lit(7), "id"), F.col("parts")))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    # an index row lies in its block for every part, an asking row in its part for every block
    own = lambda r: F.struct(F.col("b").alias("b"), F.col("p").alias("p"), F.lit(r).alias("r"))
    index = lambda but: F.transform(F.filter(every("parts"), lambda p: p != but), lambda p: F.struct(F.col("b").alias("b"), p.alias("p"), F.lit(0).alias("r")))
    asks = lambda but: F.transform(F.filter(every("blocks"), lambda b: b != but), lambda b: F.struct(b.alias("b"), F.col("p").alias("p"), F.lit(2).alias("r")))
    nowhere = F.lit(-1)
    places = F.when(role == 0, index(nowhere)).when(role == 2, asks(nowhere)).otherwise(F.concat(F.array(own(1)), index(F.col("p")), asks(F.col("b"))))
    spread = joined.withColumn("at", F.explode(places))
    at = F.shiftleft(F.shiftleft(F.col("leaf"), _BLOCK_BITS).bitwiseOR(F.col("at.b")), _PART_BITS).bitwiseOR(F.col("at.p"))
    return spread.select(F.shiftleft(at, _ROLE_BITS).bitwiseOR(F.col("at.r").cast("long")).alias("key"), "id", "code")


class _Place:
    """The index rows of one place, which asking rows meet a tile at a time."""

    def __init__(self, bits: int):
        self.bits, self.parts, self.base = bits, [], None

    def add(self, ids, role, code):
        self.parts.append((ids, role, code))

    def close(self):
        if self.base is None:
            self.ids = np.concatenate([p[0] for p in self.parts]) if self.parts else np.zeros(0, dtype=np.int64)
            self.both = np.concatenate([p[1] for p in self.parts]) == 1 if self.parts else np.zeros(0, dtype=bool)
            self.base = decode(np.concatenate([p[2] for p in self.parts]), self.bits) if self.parts else np.zeros((0, 1), dtype=np.float32)
            self.parts = []

    def pairs(self, ids, vec, both: bool, least: float):
        """(a, b): a < b with a cosine of at least ``least``. Of two rows that ask each other here, one does."""
        sims = vec @ self.base.T
        i, j = np.nonzero(sims >= least)
        a, b = ids[i], self.ids[j]
        ok = (a < b) | ((a != b) & ~self.both[j]) if both else a != b
        return np.minimum(a, b)[ok], np.maximum(a, b)[ok]

    def best(self, ids, vec, k: int):
        """(a, b, cosine): the ``k`` highest of each asking row, the smaller id first among equal cosines."""
        sims = vec @ self.base.T
        sims[ids[:, None] == self.ids[None, :]] = -2
        top = min(k, sims.shape[1])
        floor = np.partition(sims, sims.shape[1] - top, axis=1)[:, -top]
        i, j = np.nonzero(sims >= np.maximum(floor, -1.5)[:, None] - 1e-5)
        cosine = np.empty(len(i))
        for at in range(0, len(i), 1 << 16):
            x, y = vec[i[at : at + (1 << 16)]].astype(np.float64), self.base[j[at : at + (1 << 16)]].astype(np.float64)
            cosine[at : at + (1 << 16)] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
        cosine[sims[i, j] < -1.5] = -2
        order = np.lexsort((self.ids[j], -cosine, i))
        i, j, cosine = i[order], j[order], cosine[order]
        begin = np.searchsorted(i, i)
        ok = (np.arange(len(i)) - begin < k) & (cosine > -1.5)
        return ids[i][ok], self.ids[j][ok], cosine[ok]


def _meet(placed: DataFrame, bits: int, width: int, least: float | None, k: int) -> DataFrame:
    """Of each place (a, b), a < b, with cosines of the codes of at least ``least``, or (a, b, cosine) with the ``k`` highest
    of each asking row a."""

    def ask(place: _Place, ids, vec, both):
        place.close()
        for at in range(0, len(ids) if len(place.ids) else 0, TILE):
            some, v = ids[at : at + TILE], vec[at : at + TILE]
            columns = place.pairs(some, v, both, least) if least is not None else place.best(some, v, k)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "cosine"][: len(columns)])

    def finish(place: _Place | None):
        if place is not None:
            place.close()
            yield from ask(place, place.ids[place.both], place.base[place.both], True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            place, role = key >> _ROLE_BITS, key & 3
            ids, code = batch.column(1).to_numpy(), _matrix(batch.column(2), "u1", width)
            edges = [0, *(np.flatnonzero((np.diff(place) != 0) | (np.diff(role == 2) != 0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:]):
                if place[s] != last:
                    yield from finish(held)
                    held, last = _Place(bits), place[s]
                if role[s] < 2:
                    held.add(ids[s:e], role[s:e], code[s:e].copy())
                else:
                    yield from ask(held, ids[s:e], decode(code[s:e], bits), False)
        yield from finish(held)

    rows = placed.repartition(F.shiftright("key", _ROLE_BITS)).sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long" + ("" if least is not None else ", cosine double"))


def _exact(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """``pairs`` (a, b) with the cosine of the full vectors, which travel once."""
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    met = ends.join(vectors.select("id", "unit"), "id").groupBy("a", "b").agg(
        F.min_by("unit", "id").alias("x"), F.max_by("unit", "id").alias("y")
    )

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_matrix(batch.column(i), "<f4", dim).astype(np.float64) for i in (2, 3))
            norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x * y).sum(1) / norm)], names=["a", "b", "cosine"])

    return met.mapInArrow(dot, "a long, b long, cosine double")


def _forest(vectors: DataFrame, dim: int, trees: int, depth: int, rows: int, seed: int):
    """The broadcast forest: its thresholds are 4 bytes a leaf and tree, a small share of the vectors it indexes."""
    first = min(depth, (SAMPLE // SAMPLE_OF_LEAF).bit_length() - 1)
    forest = fit(_sample(vectors, rows, dim, SAMPLE), trees, first, seed)
    rng = np.random.default_rng([seed, 1])
    for _ in range(first, depth):
        more = rng.standard_normal((trees, 1, dim)).astype(np.float32)
        more /= np.linalg.norm(more, axis=2, keepdims=True)
        forest = _deepened(vectors, rows, Forest(np.concatenate([forest.directions, more], axis=1), forest.thresholds), dim)
    return vectors.sparkSession.sparkContext.broadcast(forest)


def similar_pairs(
    vectors: DataFrame, dim: int, least: float, trees: int = 6, visits: int = 10, leaf: int = 512, seed: int = 11
) -> DataFrame:
    """(a, b, cosine), a < b: pairs of ``vectors`` (id long, unit binary, see ``unit_vectors``) with a cosine of at
    least ``least``, found with the recall measured in the README.

    Every vector asks and is asked. Equal vectors under different ids are pairs; repeated ids are one vector and
    must not differ. An empty collection gives an empty result. ``vectors`` is read several times and should be
    materialised.
    """
    bits, rows = 4, vectors.count()
    forest = _forest(vectors, dim, trees, _depth(rows, leaf), rows, seed)
    visits = max(visits, trees)
    placed = _split(_placed(vectors, forest, dim, bits, visits, None), _placed(vectors, forest, dim, None, visits, None))
    slack = 0.085  # four times the spread of the error of two 4-bit codes
    near = _meet(placed, bits, 4 + dim // 2, least - slack, 0).distinct()
    return _exact(near, vectors, dim).filter(F.col("cosine") >= least)


def _highest(met: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest different b of each a; at most that many a task travel, copies from several trees aside."""
    order = W.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return met.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= k).dropDuplicates(["a", "b"])


def _visits_for(vectors: DataFrame, forest, dim: int, k: int, asks: str, recall: float) -> int:
    """The least number of visits that finds ``recall`` of the true ``k`` nearest of at most ASKED asking rows."""
    some = vectors.filter(asks).orderBy(F.xxhash64(F.lit(13), F.col("id")), "id").limit(ASKED)
    got = some.select("id", "unit").toArrow()
    ids, units = got.column("id").to_numpy(), _column(some, dim) if got.num_rows else np.zeros((0, dim), "<f4")
    if not len(ids):
        return forest.value.directions.shape[0]
    asked = vectors.sparkSession.sparkContext.broadcast((ids, units))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, what = asked.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                place = _Place(32)
                place.ids, place.both, place.base = part.column(0).to_numpy(), None, _matrix(part.column(1), "<f4", dim)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in place.best(who, what, k)], names=["a", "b", "cosine"])

    true = _highest(vectors.select("id", "unit").mapInArrow(brute, "a long, b long, cosine double"), k).select("a", F.col("b").alias("id"))
    true = true.join(vectors.select("id", "unit"), "id").select("a", "unit").toArrow()  # at most ASKED x k rows
    place = {x: i for i, x in enumerate(ids.tolist())}
    row = np.array([place[a] for a in true.column("a").to_pylist()], dtype=np.int64)
    found = true.column("unit").combine_chunks()
    found = _matrix(found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks), "<f4", dim)
    f: Forest = forest.value
    trees = f.directions.shape[0]
    homes = f.visits(found, trees)
    count, every = 8 * trees, trees * f.leaves
    while len(row):
        count = min(2 * count, every)
        met = f.visits(units, count)
        rank = np.full(len(row), every, dtype=np.int64)
        for at in range(0, len(row), 256):
            same = (met[row[at : at + 256], :, None] == homes[at : at + 256, None, :]).any(2)
            rank[at : at + 256] = np.where(same.any(1), same.argmax(1), every)
        need = int(np.sort(rank)[int(np.ceil(recall * len(rank))) - 1]) + 1
        if need <= count or count == every:
            return max(trees, min(need, every))
    return trees


def nearest(
    vectors: DataFrame, dim: int, k: int, asks: str, trees: int = 2, visits: int | None = None, leaf: int = 8192, seed: int = 11,
    recall: float = 0.94, exact: bool = False,
) -> DataFrame:
    """(id, neighbour, cosine, place): the ``k`` vectors of the highest cosine for each row whose ``asks`` is true.

    The row itself is left out; equal cosines are ordered by the neighbour's id. Fewer than ``k`` rows come out
    when the collection is smaller. ``visits`` leaves are searched for each row; by default as many as reach ``recall`` on
    the measured rows. ``exact`` compares each asking row with all vectors, in blocks.
    """
    rows = vectors.count()
    trees, depth = (1, 0) if exact else (trees, _depth(rows, leaf))
    forest = _forest(vectors, dim, trees, depth, rows, seed)
    if visits is None:
        visits = 1 if exact else _visits_for(vectors, forest, dim, k, asks, recall)
    visits = max(visits, trees)
    placed = _split(_placed(vectors, forest, dim, 32, visits, asks), _placed(vectors, forest, dim, None, visits, asks))
    best = _highest(_meet(placed, 32, 4 * dim, None, k), k)
    return best.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine", "place")


def joint_collection(results: DataFrame, dim: int = 64) -> DataFrame:
    """(id, unit): one vector per row's ``styled_text_style_emb`` (id = 2 row_id) and one per example's
    ``text_style_emb`` (id = 2 example_number + 1, the usable one of the smallest row_id)."""
    styled = unit_vectors(results, "row_id", "styled_text_style_emb", dim).withColumn("id", F.col("id") * 2)
    texts = unit_vectors(results.filter(F.col("example_number").isNotNull()), "row_id", "text_style_emb", dim, keep=("example_number",))
    per_example = texts.groupBy("example_number").agg(F.min_by("unit", "id").alias("unit"))
    return styled.select("id", "unit").unionByName(per_example.select((F.col("example_number") * 2 + 1).alias("id"), "unit"))


def name_of(column: str):
    """Names of the joint collection: s + row_id, t + example_number."""
    c = F.col(column)
    return F.concat(F.when(c % 2 == 0, F.lit("s")).otherwise(F.lit("t")), F.floor(c / 2).cast("long").cast("string"))
