"""Near copies by the similarity of their shingles, for the pipeline.

Fingerprints at a few bits find documents that are all but equal. At a Jaccard
similarity of 0.8 two fingerprints differ in ten of 64 bits on average, and a
grid that is exact for so many bits compares a good part of all pairs. So
candidates come from two sides, the grid join of ``simhash`` and bands of
MinHashes of the same shingles, and every link is verified on whole shingle
sets.

1. Blocks of documents give each row a hash of its words, its fingerprint and
   its bands. Rows of equal words are one node.
2. Nodes that share a band or are near on the grid are joined to groups; within
   bands by links to the smallest node, so no pairs are listed.
3. Blocks send the shingle sets of nodes in groups, once each; large groups are
   compared chunk by chunk (``cells``). Of the pairs that share a band or have
   near fingerprints those are verified that aren't connected yet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import simhash
from tracelake.llm.blocks import answered, blocks, each_block
from tracelake.llm.cells import grouped, whole_groups
from tracelake.llm.components import components
from tracelake.llm.shared import written
from tracelake.llm.simhash import majority, shingle_hashes

#: A pair at a similarity of 0.8 shares one of 16 bands of 4 with a chance of
#: 0.9998.
BANDS, ROWS = 16, 4
#: Nodes of a group that are compared at a time.
CAP = 1024
_FACTORS = np.random.default_rng(31).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = np.random.default_rng(32).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """One hash for each band of the least of ROWS keyed hashes."""
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None] * _FACTORS + _SHIFTS
        least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=0))
    out = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (band, h, node), sorted, to the first of their bucket."""
    band = key = first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        b, h, node = (batch.column(c).to_numpy() for c in ("band", "h", "node"))
        new = np.r_[True, (b[1:] != b[:-1]) | (h[1:] != h[:-1])]
        new[0] = (b[0], h[0]) != (band, key)
        start = np.maximum.accumulate(np.where(new, np.arange(len(b)), -1))
        least = np.where(start >= 0, node[start], first if first is not None else 0)
        band, key, first = b[-1], h[-1], least[-1]
        own = np.flatnonzero(~new)
        if len(own):
            yield pa.RecordBatch.from_arrays([pa.array(least[own]), pa.array(node[own])], names=["a", "b"])


def verified(batches: Iterable[pa.RecordBatch], similarity: float, distance: int) -> Iterator[pa.RecordBatch]:
    """Links that connect what all similar pairs of a group connect."""
    for table, group in whole_groups(batches, ["g", "_i", "_j"]):
        bands = np.stack(table.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS))
        fp, node, side = table.column("fp").to_numpy().view(np.uint64), table.column("node").to_numpy(), table.column("_s").to_numpy()
        crossing = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        other = (crossing & (side == table.column("_j").to_numpy())).astype(np.int64)
        sets = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("shingles")]
        label, tried = np.arange(len(group)), set()
        left, right = [], []

        def linked(x: int, y: int, label=label, tried=tried, left=left, right=right, node=node, sets=sets) -> bool:
            if (x, y) in tried or (crossing[x] and side[x] == side[y]):
                return False
            tried.add((x, y))
            if jaccard(sets[x], sets[y]) < similarity:
                return False
            label[label == label[y]] = label[x]
            left.append(int(node[x]))
            right.append(int(node[y]))
            return True

        for k in range(BANDS):
            order = np.lexsort((np.arange(len(group)), bands[:, k], group))
            same = (group[order][1:] == group[order][:-1]) & (bands[order, k][1:] == bands[order, k][:-1])
            edge = np.flatnonzero(np.diff(np.r_[0, same.astype(np.int8), 0]))
            for a, b in edge.reshape(-1, 2).tolist():
                # clusters of what is connected, by side of a pair of chunks: a
                # tight bucket takes one comparison a row
                clusters: list[tuple[list[int], list[int]]] = []
                for y in order[a : b + 1].tolist():
                    mine, apart = ([], []), []
                    for own in clusters:
                        known = (own[0] or own[1])[0]
                        if label[known] == label[y] or any(linked(x, y) for x in own[int(crossing[y]) * (1 - other[y])]):
                            large, small = (own, mine) if len(own[0]) + len(own[1]) >= len(mine[0]) + len(mine[1]) else (mine, own)
                            large[0].extend(small[0])
                            large[1].extend(small[1])
                            mine = large
                        else:
                            apart.append(own)
                    mine[int(other[y])].append(y)
                    clusters = [*apart, mine]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
            for x in range(s, e - 1):
                near = np.bitwise_count(fp[x] ^ fp[x + 1 : e]) <= distance
                for y in (np.flatnonzero(near & (label[x + 1 : e] != label[x])) + x + 1).tolist():
                    if label[y] != label[x]:
                        linked(x, y)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def groups(
    held: DataFrame, kind: str, similarity: float, shingle: int, distance: int, seed: int, id_col: str, text_col: str, cap: int = CAP
) -> DataFrame:
    """Rows (block, row, id, c) of blocks of documents with an id: rows of
    equal c are connected by links of at least the similarity."""

    def sketches(block: int, rows: pa.Table, _) -> Iterator[pa.RecordBatch]:
        ids, words, fps, bands, own = rows.column(id_col).combine_chunks(), [], [], [], []
        for i, text in enumerate(rows.column(text_col).to_pylist()):
            if ids[i].is_valid:
                own.append(i)
                words.append(xxhash.xxh3_128_digest(b" ".join((text or "").encode("utf-8").lower().split())))
                hashes = shingle_hashes(text, shingle, seed)
                fps.append(majority(hashes))
                bands.append(bands_of(hashes).view(np.int64))
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
        arrays = [pa.array(np.full(len(own), block)), pa.array(own, pa.int32()), ids.take(pa.array(own, pa.int32()))]
        arrays += [pa.array(words, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), lists]
        yield pa.RecordBatch.from_arrays(arrays, names=["block", "row", "id", "words", "fp", "bands"])

    rows = written(each_block(held, f"block long, row int, id {kind}, words binary, fp long, bands array<long>", sketches), "sketches")
    place = F.struct("block", "row")
    nodes = rows.groupBy("words").agg(F.min(place).alias("p"), F.min_by("fp", place).alias("fp"), F.min_by("bands", place).alias("bands"))
    nodes = written(nodes.select("words", F.monotonically_increasing_id().alias("node"), "p.block", "p.row", "fp", "bands"), "nodes")
    exploded = nodes.select("node", F.posexplode("bands").alias("band", "h"))
    exploded = exploded.repartition("band", "h").sortWithinPartitions("band", "h", "node")
    near = exploded.mapInArrow(neighbours, "a long, b long")
    distinct = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    equal = nodes.join(distinct.withColumnRenamed("node", "a"), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    grid = simhash.links(distinct, distance, simhash.choose_blocks(nodes.count(), distance))
    candidates = components(near.unionByName(equal).unionByName(grid))
    wanted = written(nodes.join(candidates.withColumnRenamed("component", "g"), "node"), "wanted")
    asked = wanted.select("block", F.col("row").alias("shard"), F.struct("g", "node", "fp", "bands").alias("data"))
    lists = asked.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("answers"))

    def shingles(block: int, table: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        texts = table.column(text_col)
        for at in range(0, len(answers), 256):
            part = answers[at : at + 256]
            sets = [np.unique(shingle_hashes(texts[i].as_py(), shingle, seed)).astype("<u8").tobytes() for i, _ in part]
            columns = [pa.array([d[c] for _, d in part], t) for c, t in (("g", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sets, pa.binary())], names=["g", "node", "fp", "bands", "shingles"])

    sent = each_block(held.join(lists, "block"), "g long, node long, fp long, bands array<long>, shingles binary", shingles)
    compared = grouped(written(sent, "shingles"), ["g"], "node", cap)

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return verified(batches, similarity, distance)

    joined = components(compared.mapInArrow(links, "a long, b long"))
    classes = nodes.select("words", "node").join(joined, "node", "left").select("words", F.coalesce("component", "node").alias("c"))
    return rows.select("block", "row", "id", "words").join(classes, "words").select("block", "row", "id", "c")


def without_near_copies(
    docs: DataFrame,
    similarity: float = 0.8,
    shingle: int = 5,
    distance: int = 4,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    cap: int = CAP,
) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay: of every group of
    near copies the one with the least id (of repeated ids the first row).

    Documents link if the sets of their shingles have a Jaccard similarity of
    ``similarity`` or more; groups are what links connect. Texts without words
    (null, empty) are alike; texts of fewer words than a shingle are alike if
    their words are the same. Of repeated rows one stays; of rows with one id
    and different texts each counts for itself. A row without an id stays and
    removes none. Equality of words is by 128-bit hashes, of shingles by 64.
    """
    held = blocks(docs, text_col)
    found = groups(held, docs.schema[id_col].dataType.simpleString(), similarity, shingle, distance, seed, id_col, text_col, cap)
    found = written(found, "groups")
    place = F.struct("id", "block", "row")
    first = found.groupBy("c").agg(F.min(place).alias("stays"), F.count("*").alias("n")).where("n > 1")
    gone = found.join(first, "c").where(place != F.col("stays"))
    gone = gone.select("block", F.col("row").alias("shard"), F.lit(b"").alias("data"))

    def kept(block: int, rows: pa.Table, answers) -> Iterator[pa.RecordBatch]:
        stays = np.ones(rows.num_rows, bool)
        stays[[i for i, _ in answers]] = False
        yield from rows.filter(pa.array(stays)).combine_chunks().to_batches()

    return each_block(answered(held, gone), docs.schema, kept)
