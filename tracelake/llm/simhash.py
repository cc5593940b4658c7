"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is seen as 32 segments of two bits. The counts of set bits
per segment (0, 1 or 2) are its embedding; the Manhattan distance of two
embeddings is a lower bound of the Hamming distance of the fingerprints. Counts
are written in unary (00, 01, 11) into 64 bits, so that this distance is a
count of differing bits too.

The range join runs on grids. The segments are dealt to b blocks. Embeddings at
distance r differ in at most r blocks, so for some choice of b - r blocks they
share the grid cell that those blocks' counts name. For every choice each
distinct fingerprint goes to one cell. Within a cell the Manhattan distance is
taken over all segments, and pairs within it are verified on the fingerprints.
The join is exact for every b; b only trades copies for candidates and grows
with the number of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.arrow import map_slices
from tracelake.llm.cells import compare, forest, grouped, whole_groups
from tracelake.llm.components import components
from tracelake.llm.shared import written

#: Chance that two random two-bit segments have equal counts.
EQUAL = 0.375
#: Comparisons that a copy of a fingerprint costs, for the choice of b.
COPY = 32
#: Rows of a cell from which it is cut into chunks.
CAP = 4096
#: Groups up to this size are compared offset by offset, larger ones by row.
SMALL = 64


def shingle_hashes(text: str | None, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, joined by a space, repeats
    included; of all words if there are fewer, none if there are none. A-Z are
    lower-cased; words are split at ASCII space."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    data = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    k = min(shingle, len(words))
    return np.array([xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is in over half the hashes; zero of none."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def _hash_step(shingle: int, seed: int):
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return step


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp), fp as a signed 64-bit integer."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    return map_slices(df, "text", f"id {kind}, fp long", partial(_hash_step, shingle, seed))


def embedding(fp: Column) -> Column:
    """Counts of the two-bit segments, in unary."""
    odd = F.lit(0x5555555555555555)
    high = F.shiftrightunsigned(fp, 1)
    any_set = fp.bitwiseOR(high).bitwiseAND(odd)
    both_set = fp.bitwiseAND(high).bitwiseAND(odd)
    return any_set.bitwiseOR(F.shiftleft(both_set, 1))


def block_masks(blocks: int) -> list[int]:
    """Bits of each block's segments."""
    cuts = [32 * i // blocks for i in range(blocks + 1)]
    return [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def choose_blocks(n: int, distance: int) -> int:
    """The number of blocks with the least work for a fingerprint: its copies,
    one per choice of blocks, and the candidates in their cells."""

    def work(b: int) -> float:
        return comb(b, distance) * (COPY + n * EQUAL ** (32 * (b - distance) / b))

    return min(range(distance + 1, 33), key=work)


def grids(blocks: int, distance: int) -> list[int]:
    """For every choice of blocks the mask of their segments, as signed."""
    masks = block_masks(blocks)
    chosen = [sum(c) for c in combinations(masks, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def _links(batches: Iterable[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    for table, group in whole_groups(batches, ["t", "cell", "_i", "_j"]):
        fp = table.column("fp").to_numpy().view(np.uint64)
        near = table.column("e").to_numpy().view(np.uint64)
        node, side = table.column("node").to_numpy(), table.column("_s").to_numpy()
        crossing = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        size = np.bincount(group)[group]

        def linked(a, b, fp=fp, near=near):
            ok = np.bitwise_count(near[a] ^ near[b]) <= distance
            ok[ok] = np.bitwise_count(fp[a[ok]] ^ fp[b[ok]]) <= distance
            return ok

        few = np.flatnonzero(size <= SMALL)
        a, b = compare(group[few], crossing[few], side[few], lambda x, y, few=few, linked=linked: linked(few[x], few[y]))
        left, right = forest(node[few[a]], node[few[b]])
        for g in np.unique(group[size > SMALL]):
            rows = np.flatnonzero(group == g)
            label = np.arange(len(rows))
            for k in range(len(rows) - 1):
                rest = rows[k + 1 :]
                if crossing[rows[k]]:
                    rest = rest[side[rest] != side[rows[k]]]
                hit = rest[linked(np.full(len(rest), rows[k]), rest)] - rows[0]
                new = np.unique(label[hit])
                new = new[new != label[k]]
                for other in new.tolist():
                    left.append(int(node[rows[k]]))
                    right.append(int(node[rows[hit[label[hit] == other][0]]]))
                    label[label == other] = label[k]
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, distance: int, blocks: int, cap: int = CAP) -> DataFrame:
    """Links (a, b) between nodes of distinct fingerprints (fp, node): a set
    that connects exactly what all links within ``distance`` connect."""
    cells = F.array(*[F.struct(F.lit(t).alias("t"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for t, m in enumerate(grids(blocks, distance))])
    rows = distinct.withColumn("e", embedding(F.col("fp"))).select("fp", "node", "e", F.explode(cells).alias("c"))
    rows = rows.select("c.t", "c.cell", "fp", "node", "e")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _links(batches, distance)

    return grouped(rows, ["t", "cell"], "fp", cap).mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    distance: int = 4,
    shingle: int = 4,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    cap: int = CAP,
) -> DataFrame:
    """Rows (id, fingerprint, component_id), one per row of ``docs``.

    Documents link at ``distance`` or fewer differing bits. Equal fingerprints
    are one node of the join, so copies cost nothing there. Null and empty
    texts have fingerprint zero and link like others. Rows of one id are one
    document: whatever either links with is reachable from both. A row whose
    id is null gets its fingerprint, a null component, and links nothing. Ids
    may be of any type that has an order. Other columns aren't read.
    """
    fps = written(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    named = fps.where("id is not null")
    distinct = written(named.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    found = links(distinct.select("fp", F.col("fp").alias("node")), distance, choose_blocks(distinct.count(), distance), cap)
    several = named.groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b")
    again = named.join(several.select("id", "a"), "id").select("a", F.col("fp").alias("b"))
    joined = components(found.unionByName(again)).withColumnRenamed("node", "fp")
    classes = distinct.join(joined, "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    least = classes.groupBy("c").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "c").select("fp", "component_id")
    return fps.join(classes, "fp", "left").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
