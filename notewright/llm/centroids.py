"""Exact centroid clustering of integer vectors.

Distances come from |x|^2 - 2 x.c + |c|^2 in blocked float64 matrix products. All numbers are integers, so the products
are exact as long as every magnitude that can arise stays below 2^53; rows beyond that bound are computed in int64, and
beyond that in Python's integers. Spark cuts the table into blocks of rows, and treeAggregate combines their sums.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from notewright.llm.common import durable

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Rows of one matrix product, and of one where products are made element by element.
BLOCK_ROWS, SMALL_ROWS = 4096, 256
#: Largest magnitudes that are exact in float64 and in int64.
EXACT, WIDE = 2**53, 2**62
LONGEST = 2**63 - 1

Point = tuple[int, ...]


def kept_vectors(vectors: DataFrame, id_col: str, vec_col: str, dimensions: int) -> DataFrame:
    """(vec_id, v): vectors of exactly ``dimensions`` components, none null or non-finite, in their own precision."""
    kind = vectors.schema[vec_col].dataType
    narrow = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    v = F.col(vec_col) if narrow else F.col(vec_col).cast("array<double>")
    named = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return named.where((F.size("v") == dimensions) & finite)


def vector_blocks(kept: DataFrame, dimensions: int) -> DataFrame:
    """(ids, m): the rows of each Arrow batch as one matrix of bytes, in the components' own precision."""
    wide = np.float32 if isinstance(kept.schema["v"].dataType.elementType, FloatType) else np.float64
    id_type = kept.schema["vec_id"].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(s, BLOCK_ROWS)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(wide)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.record_batch([ids, pa.array([flat.tobytes()], pa.binary())], ["ids", "m"])

    return kept.mapInArrow(pack, f"ids array<{id_type.simpleString()}>, m binary")


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as float64 where that is finite; an object array of Python's integers where it is not."""
    with np.errstate(over="ignore"):
        v = np.floor(np.float64(SCALE) * x.astype(np.float64))
    if np.isfinite(v).all():
        return v
    return np.array([[math.floor(float(e) * SCALE) if abs(e) < 1e300 else int(e) * SCALE for e in row] for row in x], dtype=object)


def _exact(v: np.ndarray) -> np.ndarray:
    return np.array([[int(e) for e in row] for row in v], dtype=object).reshape(v.shape)


def nearest(v: np.ndarray, centroids: list[Point]) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid; of equally near ones the smaller number.

    Distances are Python's integers in an object array where any row needs them, else int64.
    """
    rows, dims = v.shape
    top = max(abs(e) for c in centroids for e in c)
    number = np.empty(rows, np.int64)
    distance = np.empty(rows, object)
    reach = np.abs(v).max(axis=1, initial=0)
    limit = [math.isqrt(bound // dims) - top for bound in (EXACT, WIDE)]  # dims * (|x| + |c|)^2 stays below the bound
    level = np.where(reach < max(limit[0], 0), 0, np.where(reach < max(limit[1], 0), 1, 2)) if v.dtype != object else np.full(rows, 2)
    if (level < 2).any():
        narrow = np.array(centroids, dtype=np.int64)
    fast = np.flatnonzero(level == 0)
    if len(fast):
        c = narrow.astype(np.float64)
        for s in range(0, len(fast), BLOCK_ROWS):
            at = fast[s : s + BLOCK_ROWS]
            x = v[at]
            d = np.einsum("ij,ij->i", x, x)[:, None] - 2.0 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]
            number[at] = d.argmin(axis=1)
            distance[at] = d.min(axis=1).astype(np.int64)
    middle = np.flatnonzero(level == 1)
    for s in range(0, len(middle), SMALL_ROWS):
        at = middle[s : s + SMALL_ROWS]
        gap = v[at].astype(np.int64)[:, None, :] - narrow[None, :, :]
        d = (gap * gap).sum(axis=2)
        number[at], distance[at] = d.argmin(axis=1), d.min(axis=1)
    for at in np.flatnonzero(level == 2):
        x = [int(e) for e in v[at]]
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids]
        distance[at] = min(d)
        number[at] = d.index(distance[at])
    return number, distance


def cluster_sums(v: np.ndarray, number: np.ndarray, clusters: int) -> np.ndarray:
    """Componentwise sums by cluster, exact, as Python's integers; in float64 products while those stay exact."""
    if v.dtype != object and len(v) and np.abs(v).max() * len(v) < EXACT:
        one = np.zeros((clusters, len(v)))
        one[number, np.arange(len(v))] = 1.0
        return (one @ v).astype(np.int64).astype(object)
    out = np.zeros((clusters, v.shape[1]), dtype=object)
    for k, row in zip(number, _exact(v), strict=True):
        out[k] += row
    return out


def _matrix(m: bytes, kind: type, dimensions: int) -> np.ndarray:
    return integers(np.frombuffer(bytes(m), dtype=kind).reshape(-1, dimensions))


def _totals(blocks: DataFrame, kind: type, dimensions: int, centroids: list[Point]) -> tuple[list[int], np.ndarray, list[int]]:
    """(counts, sums, inertias) by cluster over all blocks."""
    k = len(centroids)

    def add(total: tuple, block) -> tuple:
        v = _matrix(block["m"], kind, dimensions)
        number, distance = nearest(v, centroids)
        inertia = [int(distance[number == c].sum()) for c in range(k)]
        counts = np.bincount(number, minlength=k).tolist()
        return join(total, (counts, cluster_sums(v, number, k), inertia))

    def join(a: tuple, b: tuple) -> tuple:
        return [x + y for x, y in zip(a[0], b[0], strict=True)], a[1] + b[1], [x + y for x, y in zip(a[2], b[2], strict=True)]

    zero = ([0] * k, np.zeros((k, dimensions), dtype=object), [0] * k)
    return blocks.select("m").rdd.treeAggregate(zero, add, join)


def _moved(centroids: list[Point], counts: list[int], sums: np.ndarray) -> list[Point]:
    return [tuple(int(s) // n for s in row) if n else c for c, n, row in zip(centroids, counts, sums, strict=True)]


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite; a component x counts as
    floor(64 * x). The first centroids are the kept vectors whose ids' hashes are smallest (equal hashes: smaller
    components first; null ids last): fewer vectors than ``clusters`` give fewer centroids. Equal vectors may be
    centroids twice; ties go to the smaller number, and empty clusters stay where they are. Repeated rows and null
    ids each get their row, other columns are not read. A distance or sum over 2^63 - 1 fits no long and is null.
    An empty table gives no rows. Vectors are kept once as blocks in the checkpoint folder, which every round reads;
    the driver holds the centroids and their sums only.
    """
    kept = kept_vectors(vectors, id_col, vec_col, dimensions)
    kind = np.float32 if isinstance(kept.schema["v"].dataType.elementType, FloatType) else np.float64
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(key.alias("key"), "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return kept.sparkSession.createDataFrame([], schema)
    centroids = [tuple(int(e) for e in row) for row in integers(np.array([r["v"] for r in first], dtype=kind))]
    blocks = durable(vector_blocks(kept, dimensions))
    for _ in range(rounds):
        counts, sums, _ = _totals(blocks, kind, dimensions, centroids)
        centroids = _moved(centroids, counts, sums)
    inertias = _totals(blocks, kind, dimensions, centroids)[2]
    return blocks.mapInArrow(_assign(kind, dimensions, centroids, inertias), schema)


def _assign(kind: type, dimensions: int, centroids: list[Point], inertias: list[int]) -> Callable:
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def fits(x: int) -> int | None:
        return x if x <= LONGEST else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                number, distance = nearest(_matrix(b.column(1)[i].as_py(), kind, dimensions), centroids)
                numbers = number.tolist()
                yield pa.record_batch(
                    [
                        b.column(0)[i].values,
                        pa.array(numbers, pa.int32()),
                        pa.array([fits(int(d)) for d in distance], pa.int64()),
                        pa.array([fits(inertias[k]) for k in numbers], pa.int64()),
                        pa.array([fits(sum(inertias))] * len(numbers), pa.int64()),
                        pa.array([digests[k] for k in numbers], pa.string()),
                    ],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return assign
