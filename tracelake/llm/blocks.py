"""Documents in blocks, and exchanges between blocks and shards.

Operators that look up millions of small keys for every document would drown
in rows. Here whole rows of the input are kept in blocks of a few megabytes
(compressed Arrow), written once, bucketed by block, to the shared folder. A
block sends each shard one row with all its keys, and gets one row back; only
those rows are shuffled, the text is not: joins on ``block`` use the buckets.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.arrow import BATCH_ROWS, release, slices
from tracelake.llm.shared import new_path
from tracelake.session import share_code

#: Text in a block; a longer text is a block alone.
BLOCK_BYTES = 4 << 20


def dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def load(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def _pack(batches: Iterable[pa.RecordBatch], text_col: str, limit: int) -> Iterator[pa.RecordBatch]:
    part, seq, waiting, held = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        nonlocal seq, waiting, held
        whole = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        block = (part << 32) | seq
        seq, waiting, held = seq + 1, [], 0
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([dump(whole)], pa.binary())], names=["block", "payload"])

    for batch in batches:
        for piece in slices(batch, text_col, limit):
            size = piece.column(text_col).nbytes if piece.num_rows else 0
            if waiting and held + size > limit:
                yield row()
            if piece.num_rows:
                waiting.append(piece)
                held += size
    if waiting:
        yield row()


def blocks(docs: DataFrame, text_col: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, payload), bucketed by block; payload is Arrow data of some
    of the input's rows with all their columns. Every row is in one block."""
    spark = docs.sparkSession
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pack(batches, text_col, limit)

    packed = docs.mapInArrow(run, "block long, payload binary")
    name = f"blocks_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = packed.write.format("parquet").option("path", path).option("compression", "none")
    writer.bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and what is read is known
    return table


def answered(held: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with ``answers``, the list of (shard, data) rows sent to each;
    the list is null for a block that got none."""
    lists = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "data")).alias("answers"))
    return held.join(lists, "block", "left")


def shards_for(held: DataFrame, least: int = 1) -> int:
    """Shards that follow the corpus: one for every two blocks, ``least`` for
    each shuffle partition, as many in every partition."""
    partitions = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return partitions * max(least, -(-held.count() // (2 * partitions)))


def by_shard(sent: DataFrame, shards: int, schema: str, step: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Applies ``step`` to the rows of each shard, one shard after another in a
    task. Shards are ranges of hashes of equal width, so tasks that take equally
    many are alike; only one shard at a time is in memory."""
    partitions = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = -(-shards // partitions)
    kinds = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def answer() -> Iterator[pa.RecordBatch]:
            out = step(pa.Table.from_batches(waiting).to_pandas())
            waiting.clear()
            release()
            if len(out):
                yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    if waiting and waiting[0].column("shard")[0].as_py() != shard[a]:
                        yield from answer()
                    waiting.append(batch.slice(a, b - a))
        if waiting:
            yield from answer()

    dealt = sent.repartitionById(partitions, F.floor(F.col("shard") / each).cast("int"))
    return dealt.sortWithinPartitions("shard").mapInArrow(run, schema)


def each_block(held: DataFrame, schema: str, step: Callable[[int, pa.Table, list[tuple[int, bytes]]], Iterable[pa.RecordBatch]]) -> DataFrame:
    """Applies ``step(block, rows, answers)`` to every block; answers are in
    order of their shard."""
    spark = held.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    columns = [c for c in ("block", "payload", "answers") if c in held.columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = []
                if "answers" in columns and batch.column("answers")[i].is_valid:
                    own = batch.column("answers")[i].values
                    found = sorted(zip(own.field("shard").to_pylist(), own.field("data").to_pylist(), strict=True))
                yield from step(batch.column("block")[i].as_py(), load(batch.column("payload")[i].as_buffer()), found)
                release()

    return held.select(*columns).mapInArrow(run, schema)


#: Before an array's bytes: its length, the size of its items, their sign.
HEAD = struct.Struct("<IBB")


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes, planes of equal significance together and
    compressed if there is something to gain; ``spread`` gives them back."""
    out = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(HEAD.pack(len(a), a.dtype.itemsize, a.dtype.kind == "u"))
        out.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")
    raw = b"".join(out)
    return b"\x01" + zstandard.compress(raw, 1) if len(raw) > 256 else b"\x00" + raw


def spread(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data[1:]) if data[0] else data[1:]
    out, at = [], 1
    for _ in range(raw[0]):
        n, size, unsigned = HEAD.unpack_from(raw, at)
        at += HEAD.size
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<{'u' if unsigned else 'i'}{size}").reshape(n))
        at += n * size
    return out


def with_steps(a: np.ndarray) -> np.ndarray:
    """Differences; small where the array hardly changes."""
    return np.diff(a, prepend=a.dtype.type(0))
