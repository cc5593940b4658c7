"""Near-duplicate vectors by p-stable hashing.

Directions are hashed by floor((a.x + b) / w) with Gaussian a, ``k`` such
values naming a bucket in each of ``tables`` tables. k is chosen for the least
work, copies in tables against unrelated vectors in buckets, and the number of
tables follows from k and the chance ``miss`` at which a pair exactly at the
threshold may be overlooked (closer pairs are far safer).

Tables hold a vector's number and a sketch, its direction in four bits a
component, not the vector. Pairs of a bucket whose sketches are too far apart
go; the others join vectors to groups of candidates. Vectors are sent once, to their group, and
compared there exactly, in double precision. Groups too large for that are
compared bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.cells import forest, grouped, whole_groups
from tracelake.llm.components import components
from tracelake.llm.shared import written
from tracelake.session import share_code

#: Width of a hash step, in units of the distance at the threshold.
WIDTH = 6.0
#: Comparisons of sketches that a row in a table costs, for the choice of k.
COPY = 1_000
#: Vectors, and sketches, of a group that are compared at a time.
CAP, SKETCHES = 1024, 1024
#: Vectors of a group of candidates from which it is compared by buckets.
LARGE = 1 << 16
#: Standard deviations that the cosine of two sketches may be below what is
#: expected at the threshold; more has a chance of 3e-7.
SLACK = 5.0


def agree(distance: float, width: float) -> float:
    """Chance that one hash value of two vectors at a distance is equal."""
    r = width / distance
    below = (1 + erf(-r / sqrt(2))) / 2
    return 1 - 2 * below - 2 / (sqrt(2 * pi) * r) * (1 - exp(-r * r / 2))


def plan(n: int, threshold: float, miss: float) -> tuple[int, int, float]:
    """k, the number of tables, and the step width for n directions."""
    edge = sqrt(2 - 2 * threshold)
    width = WIDTH * edge
    near, far = agree(edge, width), agree(sqrt(2), width)

    def tables(k: int) -> int:
        return max(1, ceil(log(miss) / log(1 - near**k)))

    k = min(range(2, 65), key=lambda k: tables(k) * (COPY + n * far**k))
    return k, tables(k), width


@lru_cache(maxsize=8)
def projections(dim: int, k: int, tables: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim, k, tables])
    return rng.standard_normal((dim, tables * k)), rng.random(tables * k)


def buckets(unit: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """A 32-bit bucket of each row in each table."""
    a, b = projections(unit.shape[1], k, tables, seed)
    steps = np.floor(unit @ a / width + b).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, k)
    out = np.full((len(unit), tables), np.uint64(unit.shape[1]))
    for i in range(k):
        out = (out ^ steps[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(32)).astype(np.uint32)


def directions(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of one dimension as unit vectors; scaled first, so that squares
    neither overflow nor vanish."""
    matrix = np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(vectors), dim)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def sketches(unit: np.ndarray) -> np.ndarray:
    """Rows of bytes: how far the sketched direction is from the true one (a
    32-bit float), then the components in steps of a seventh of the largest,
    two to a byte."""
    steps = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 7).astype(np.int8)
    near = steps / np.sqrt((steps.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    off = np.sqrt(((near - unit) ** 2).sum(axis=1)).astype("<f4")
    steps = np.pad((steps + 8).astype(np.uint8), ((0, 0), (0, unit.shape[1] % 2)), constant_values=8)
    return np.concatenate([off.view(np.uint8).reshape(-1, 4), steps[:, ::2] << 4 | steps[:, 1::2]], axis=1)


def sketched(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The directions that sketches stand for, and how far they are off."""
    off, body = np.ascontiguousarray(rows[:, :4]).view("<f4")[:, 0], rows[:, 4:]
    steps = np.stack([body >> 4, body & 15], axis=2).reshape(len(rows), -1).astype(np.float32) - 8
    return steps / np.sqrt((steps * steps).sum(axis=1, keepdims=True)), off


def lowest(off_a: np.ndarray, off_b: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """The cosine that sketches of a pair at the threshold have at least.
    Rounding turns a direction by about ``off`` to a random side: that shrinks
    cosines by (1 - off^2 / 2) and scatters them by off / sqrt(dim)."""
    shrunk = threshold * (1 - off_a**2 / 2) * (1 - off_b**2 / 2)
    return shrunk - SLACK * np.sqrt((off_a**2 + off_b**2 + off_a**2 * off_b**2) / dim) - 1e-5


def by_dimension(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """Some rows of one dimension at a time, with their directions."""
    for batch in batches:
        sizes = np.asarray(batch.column("v").value_lengths())
        for dim in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dim)
            for at in range(0, len(rows), 256):
                part = batch.take(pa.array(rows[at : at + 256]))
                yield dim, part, directions(part.column("v"), dim)


def _sketch(batches: Iterable[pa.RecordBatch], plan: tuple) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, dim, node, s): bucket names table and bucket, s is the
    sketch."""
    tables = plan[1]
    table = np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for dim, part, unit in by_dimension(batches):
        key = (buckets(unit, *plan).astype(np.uint64) << np.uint64(31)) * np.uint64(0xD1B54A32D192ED03) ^ table
        rows = [r.tobytes() for r in sketches(unit)]
        n = len(rows) * tables
        every = pa.array(np.repeat(np.arange(len(rows)), tables))
        arrays = [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.full(n, dim, np.int32)), part.column("node").take(every), pa.array(rows, pa.binary()).take(every)]
        yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "dim", "node", "s"])


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least row that each of n rows is connected to by pairs (a, b)."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == least).all():
            return least
        least = new


def _candidates(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links that connect rows of a bucket whose sketches are near."""
    for table, group in whole_groups(batches, ["bucket", "dim", "_i", "_j"]):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        node, side = table.column("node").to_numpy(), table.column("_s").to_numpy()
        crossing = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        dims, data = table.column("dim").to_numpy(), table.column("s").combine_chunks()
        left, right = [], []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
            if e - s < 2:
                continue
            found: list[tuple[np.ndarray, np.ndarray]] = []
            near, off = sketched(np.frombuffer(b"".join(data.slice(s, e - s).to_pylist()), np.uint8).reshape(e - s, -1))
            for at in range(0, e - s - 1, 256):
                own = slice(at, min(at + 256, e - s))
                hit = near[own] @ near[at:].T >= lowest(off[own, None], off[None, at:], int(dims[s]), threshold)
                if crossing[s]:
                    hit &= side[s:e][own, None] != side[None, s + at : e]
                a, b = np.nonzero(hit)
                found.append((a[a < b] + at, b[a < b] + at))
            if any(len(a) for a, _ in found):
                least = spanning(*(np.concatenate(z) for z in zip(*found, strict=True)), e - s)
                own = np.flatnonzero(least != np.arange(e - s))
                left.append(node[s + least[own]])
                right.append(node[s + own])
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def _hash(batches: Iterable[pa.RecordBatch], plan: tuple) -> Iterator[pa.RecordBatch]:
    """Rows of large groups once for each table."""
    tables = plan[1]
    for dim, part, unit in by_dimension(batches):
        n = part.num_rows
        every = pa.array(np.repeat(np.arange(n), tables))
        arrays = [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(buckets(unit, *plan).reshape(-1).astype(np.int64))]
        arrays += [pa.array(np.full(n * tables, dim, np.int32)), *[part.column(c).take(every) for c in ("node", "n", "v")]]
        yield pa.RecordBatch.from_arrays(arrays, names=["t", "bucket", "dim", "node", "n", "v"])


def first_common(unit: np.ndarray, a: np.ndarray, b: np.ndarray, t: int, plan: tuple) -> np.ndarray:
    """Whether pairs of rows of ``unit`` share no bucket in tables before t.
    Buckets are made again here, which is cheaper than carrying them along."""
    own, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    ids = np.concatenate([buckets(unit[own[i : i + 256]], *plan)[:, :t] for i in range(0, len(own), 256)])
    x, y = place[: len(a)], place[len(a) :]
    out = np.empty(len(a), bool)
    for i in range(0, len(a), 65536):
        out[i : i + 65536] = ~(ids[x[i : i + 65536]] == ids[y[i : i + 65536]]).any(axis=1)
    return out


def _verify(batches: Iterable[pa.RecordBatch], threshold: float, plan: tuple) -> Iterator[pa.RecordBatch]:
    """Per group: how many vectors each node links with, and links that span
    the group's components. Rows with a table t hold buckets: a pair counts in
    its first common one only."""
    for table, group in whole_groups(batches, ["t", "bucket", "dim", "_i", "_j"]):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        node, weight = table.column("node").to_numpy(), table.column("n").to_numpy()
        side, t, dims = table.column("_s").to_numpy(), table.column("t").to_numpy(), table.column("dim").to_numpy()
        crossing = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        vectors = table.column("v").combine_chunks()
        counts: dict[int, int] = {}
        left: list[int] = []
        right: list[int] = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
            if e - s < 2:
                continue
            unit = directions(vectors.slice(s, e - s), int(dims[s]))
            hit = unit @ unit.T >= threshold
            if crossing[s]:
                hit &= side[s:e, None] != side[None, s:e]
            a, b = np.nonzero(np.triu(hit, 1))
            if not len(a):
                continue
            if t[s] > 0:
                new = first_common(unit, a, b, int(t[s]), plan)
                a, b = a[new], b[new]
            total = np.bincount(a, weight[s + b], e - s) + np.bincount(b, weight[s + a], e - s)
            for i in np.flatnonzero(total).tolist():
                counts[int(node[s + i])] = counts.get(int(node[s + i]), 0) + int(total[i])
            x, y = forest(node[s + a], node[s + b])
            left += x
            right += y
        if counts:
            none = [None] * len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*counts, *left], pa.int64()), pa.array([*none, *right], pa.int64()), pa.array([*counts.values(), *[None] * len(left)], pa.int64())],
                names=["a", "b", "links"],
            )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.9,
    miss: float = 1e-4,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cap: int = CAP,
    sketches_cap: int = SKETCHES,
    large: int = LARGE,
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``vectors``.

    Every link found has a cosine of at least ``threshold``. Equal vectors (by
    128 bits of hashes) are one node, weighted by their number. Vectors that
    are null, zero, or hold nulls or non-finite components link with nothing
    and are kept; vectors of different lengths never link; a null id links
    nothing, has a null component and isn't kept. Repeated rows count as
    vectors each. Ids may be of any type that has an order. Other columns
    aren't read.
    """
    spark = vectors.sparkSession
    share_code(spark)
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind).alias("v"))
    big = F.lit(float("inf"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(finite & F.col("id").isNotNull(), F.lit(False)))
    rows = rows.withColumn("v", F.when(F.col("ok"), F.col("v"))).withColumns({"h": F.xxhash64("v"), "i": F.xxhash64(F.lit(seed), "v", F.lit(1))})
    rows = written(rows, "vectors")
    classes = rows.where("ok").groupBy("h", "i").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    chosen = (*plan(classes.count(), threshold, miss), seed)

    def tabled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _sketch(batches, chosen)

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _candidates(batches, threshold)

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _hash(batches, chosen)

    def verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _verify(batches, threshold, chosen)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    sent = classes.select("node", "v").mapInArrow(tabled, "bucket long, dim int, node long, s binary")
    links = grouped(sent, ["bucket", "dim"], "node", sketches_cap).mapInArrow(near, "a long, b long")
    groups = written(components(links).select("node", F.col("component").alias("g")), "groups")
    sizes = groups.groupBy("g").agg(F.count("*").alias("_size")).where(F.col("_size") > large)
    members = classes.select("node", "n", "v").join(groups, "node").join(written(sizes, "sizes"), "g", "left")
    small = members.where("_size is null").select(F.lit(-1).alias("t"), F.col("g").alias("bucket"), F.size("v").alias("dim"), "node", "n", "v")
    spread_out = members.where("_size is not null").select("node", "n", "v").mapInArrow(hashed, f"t int, bucket long, dim int, node long, n long, v {kind}")
    cells = grouped(small.unionByName(spread_out), ["t", "bucket", "dim"], "node", cap)
    found = written(cells.mapInArrow(verified, "a long, b long, links long"), "found")
    counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    info = classes.select("h", "i", "node", "n", "least").join(counted, "node", "left").join(joined, "node", "left")
    info = info.select("h", "i", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("component").alias("c"))
    first = info.where("c is not null").groupBy("c").agg(F.min("least").alias("first"))
    info = info.join(first, "c", "left").select("h", "i", "n_links", F.coalesce("first", "least").alias("component_id"))
    good = rows.where("ok").join(info, ["h", "i"]).select("id", "n_links", "component_id")
    rest = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = good.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
