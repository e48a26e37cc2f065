"""Centroid clustering in exact integers: Lloyd's rounds over blocks of vectors.

Components become integers, floor(scale * x). A block of vectors meets all centroids in one matrix product, by
|x|^2 - 2 x.c + |c|^2 in float64: as long as every term stays below 2^53, all of it are integers that float64 holds, so sums in
any order are exact. Rows beyond that bound are taken in 64-bit integers, and those beyond them in Python's. RDD treeAggregate
adds the sums of the blocks up, so the driver gets k sums of a fixed size, whatever the table's.

Blocks are written once to the shared folder and read in each round; a lost executor costs its blocks' part of a round.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.session import materialize, ship

BLOCK_ROWS = 4096
_EXACT, _LONG = 1 << 53, 1 << 62
_WIDTHS = ((2, np.int16), (4, np.int32), (8, np.int64))
_INT64 = np.iinfo(np.int64)


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of a matrix of finite doubles, as int64, or as Python integers where one does not fit."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(scale))
    if scale & (scale - 1) == 0 and (not scaled.size or np.abs(scaled).max() < _LONG):  # times a power of two is exact
        return scaled.astype(np.int64)
    exact = [[n * scale // d for n, d in (x.as_integer_ratio() for x in row)] for row in values.tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def _pack(matrix: np.ndarray) -> tuple[int, bytes]:
    """Bytes a component (0: as text) and the components of a block."""
    if matrix.dtype == object:
        return 0, json.dumps(matrix.tolist()).encode()
    top = int(max(matrix.max(), -int(matrix.min()))) if matrix.size else 0
    width, kind = next((w, t) for w, t in _WIDTHS if top <= np.iinfo(t).max)
    return width, np.ascontiguousarray(matrix.astype(kind)).tobytes()


def _unpack(width: int, data: bytes, dims: int) -> np.ndarray:
    if width == 0:
        return np.array(json.loads(bytes(data)), dtype=object).reshape(-1, dims)
    return np.frombuffer(data, dict(_WIDTHS)[width]).reshape(-1, dims).astype(np.int64)


def _plain(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances in the integers of the arrays themselves, a centroid at a time."""
    return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)


def distances(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of the rows of x (int64 or Python integers) to each centroid; int64 if all of them fit."""
    dims, top_c = x.shape[1], max(abs(v) for row in centroids for v in row)
    big = np.array(centroids, dtype=object)
    if x.dtype == object or top_c >= _LONG:
        return _plain(x.astype(object), big)
    c = big.astype(np.int64)
    top = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1) + 1).astype(np.float64) + float(top_c)  # a bound on |x_i| + |c_i| of each row
    reach = dims * top * top * (1 + 1e-9)
    out = np.zeros((len(x), len(c)), np.int64)
    small, middle = reach < _EXACT, (reach >= _EXACT) & (reach < _LONG)
    if small.any():
        a, b = x[small].astype(np.float64), c.astype(np.float64)
        out[small] = ((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    if middle.any():
        out[middle] = _plain(x[middle], c)
    rest = ~(small | middle)
    if rest.any():
        out = out.astype(object)
        out[rest] = _plain(x[rest].astype(object), big)
    return out


def assigned(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (of equal ones the smaller number) and its squared distance."""
    d = distances(x, centroids)
    nearest = np.argmin(d, axis=1)
    return nearest, d[np.arange(len(x)), nearest]


def _exact_sum(values: np.ndarray, axis: int | None = None):
    """A sum that never wraps: in int64 where the bound allows it, else in Python's integers."""
    if values.dtype != object and values.size and int(max(values.max(), -int(values.min()))) * len(values) < _LONG:
        return values.sum(axis=axis)
    return values.astype(object).sum(axis=axis)


def kept_vectors(table: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """The rows whose vector has exactly dims components, none null, NaN or infinite: `id` and `v` (array of doubles)."""
    rows = table.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter((F.size("v") == dims) & F.coalesce(finite, F.lit(False)))


def first_centroids(vectors: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The k vectors whose `seed:id` has the smallest SHA-256, in that order; ids without a value come last, rows of one id in
    the order of their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return [[int(v) for v in quantised(np.array([r["v"]], np.float64), scale)[0]] for r in first]


def as_blocks(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Blocks of up to BLOCK_ROWS vectors of a partition: ids, n, width and data. Vectors beyond 64 bits get blocks of their own."""
    shape = pa.schema([("ids", pa.list_(pa.int64())), ("n", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])

    def block(ids: list, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in ([slice(None)] if matrix.dtype != object else [far := np.array([any(abs(v) >= _LONG for v in row) for row in matrix]), ~far]):
            own = matrix[part]
            if not len(own):
                continue
            if own.dtype == object and max(abs(v) for row in own for v in row) < _LONG:
                own = own.astype(np.int64)
            width, data = _pack(own)
            names = ids if isinstance(part, slice) else [i for i, here in zip(ids, part, strict=True) if here]
            yield pa.RecordBatch.from_pydict({"ids": [names], "n": [len(own)], "width": [width], "data": [data]}, schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, waiting = [], [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, BLOCK_ROWS - waiting)
                ids += part.column(0).to_pylist()
                rows.append(np.asarray(part.column(1).flatten(), np.float64).reshape(-1, dims))
                at, waiting = at + part.num_rows, waiting + part.num_rows
                if waiting == BLOCK_ROWS:
                    yield from block(ids, quantised(np.concatenate(rows), scale))
                    ids, rows, waiting = [], [], 0
        if waiting:
            yield from block(ids, quantised(np.concatenate(rows), scale))

    return vectors.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "ids array<long>, n int, width int, data binary")


def _gathered(blocks: DataFrame, dims: int, zero: list, add: Callable[[list, np.ndarray], list]) -> list:
    """treeAggregate of the blocks' matrices; the accumulator is a list of Python integers, added place by place."""

    def seq(acc: list, row) -> list:
        return add(acc, _unpack(row["width"], row["data"], dims))

    return blocks.select("width", "data").rdd.treeAggregate(zero, seq, lambda a, b: [x + y for x, y in zip(a, b, strict=True)], 2)


def moved(blocks: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after one round: floor(sum / count) of the vectors nearest to each; one without vectors stays."""
    k = len(centroids)

    def add(acc: list, x: np.ndarray) -> list:
        nearest, _ = assigned(x, centroids)
        for j in np.unique(nearest).tolist():
            own = x[nearest == j]
            acc[j] += len(own)
            at = k + j * dims
            acc[at:at + dims] = [a + int(s) for a, s in zip(acc[at:at + dims], _exact_sum(own, 0), strict=True)]
        return acc

    total = _gathered(blocks, dims, [0] * (k + k * dims), add)
    return [[s // total[j] for s in total[k + j * dims:k + (j + 1) * dims]] if total[j] else centroids[j] for j in range(k)]


def inertias(blocks: DataFrame, centroids: list[list[int]], dims: int) -> list[int]:
    """For each centroid, the summed distance of the vectors nearest to it."""

    def add(acc: list, x: np.ndarray) -> list:
        nearest, near = assigned(x, centroids)
        for j in np.unique(nearest).tolist():
            acc[j] += int(_exact_sum(near[nearest == j]))
        return acc

    return _gathered(blocks, dims, [0] * len(centroids), add)


def cluster(table: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """A row for each kept vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the components, as decimal
    integers joined by commas).

    Rows whose vector is null, of another length, or holds a null, NaN or infinity are left out. Equal rows and equal ids stay
    apart; an id may be null. With fewer than k vectors there are as many centroids; without any, no rows. A distance or sum
    beyond 64 bits is null. Only the two named columns are read. Rounds end early once no centroid moves, as all further
    ones would give the same.
    """
    spark = table.sparkSession
    ship(spark)
    vectors = kept_vectors(table, key, vector, dims)
    centroids = first_centroids(vectors, k, seed, scale)
    schema = f"{key} long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], schema)
    blocks = materialize(as_blocks(vectors, dims, scale))
    for _ in range(rounds):
        last, centroids = centroids, moved(blocks, centroids, dims)
        if centroids == last:
            break
    fits = lambda v: v if _INT64.min <= v <= _INT64.max else None
    sums = inertias(blocks, centroids, dims)
    own, whole = [fits(s) for s in sums], fits(sum(sums))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                nearest, near = assigned(_unpack(batch.column(1)[row].as_py(), batch.column(2)[row].as_py(), dims), centroids)
                ids = batch.column(0).slice(row, 1).flatten()
                away = pa.array([fits(int(v)) for v in near], pa.int64()) if near.dtype == object else pa.array(near, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    ids.cast(pa.int64()), pa.array(nearest, pa.int32()), away, pa.array([own[j] for j in nearest], pa.int64()),
                    pa.array([whole] * len(nearest), pa.int64()), pa.array([digests[j] for j in nearest], pa.string())], names=[key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.select("ids", "width", "data").mapInArrow(run, schema)
