"""Whole documents packed into blocks of bounded size, and the exchange between blocks and buckets.

A *block* is one compressed row that holds a few MB of whole documents. A *bucket* is a hash range
of keys. Blocks send each bucket one packed array of their distinct keys, so a key that a third of
all rows hold arrives at its bucket at most once from each block, and a shuffle carries thousands
of keys a row. Buckets answer each block with bits about the keys it sent, in the order it sent
them. Blocks are cut from the input's partitions in order, so a lost executor's blocks are rebuilt
alike; the input should be a table (or anything else whose partitions come out alike again).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.llm._bytes import U64, column_bytes, releasing, runs

BLOCK = "__tl_block"
BLOB = "__tl_blob"
BUCKET = "__tl_bucket"
BLOCK_BYTES = 4 << 20
_FAST = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))


def pack_table(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=_FAST) as writer:
        writer.write_table(t)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.Table:
    """The documents of a block."""
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def in_blocks(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES, prepare: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, measured: int | None = None) -> DataFrame:
    """(block, blob): the rows of each partition in turn, ``block_bytes`` of text at a time.

    ``prepare`` turns a batch of rows into what is stored of them, ``measured`` names the column that counts then.
    """
    place = docs.columns.index(text) if measured is None else measured

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def emit() -> pa.RecordBatch:
            blob = pack_table(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array([base + k], pa.int64()), pa.array([blob], pa.binary())], names=[BLOCK, BLOB])

        for batch in batches:
            batch = prepare(batch) if prepare else batch
            _, off = column_bytes(batch.column(place))
            at = 0
            while at < batch.num_rows:
                upto = int(np.searchsorted(off, off[at] + block_bytes - size, "right")) - 1
                upto = min(max(upto, at + (not size)), batch.num_rows)
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    size += int(off[upto] - off[at])
                if upto < batch.num_rows or size >= block_bytes:
                    yield emit()
                    k, held, size = k + 1, [], 0
                at = upto
        if held:
            yield emit()

    return docs.mapInArrow(releasing(run), f"{BLOCK} long, {BLOB} binary")


def buckets_for(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Number of buckets for the text's size: fewer than blocks, so packed rows stay large."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(8, total // (6 * block_bytes))


class Sent:
    """A block's distinct keys in the order it sends them: by bucket, then by value.

    Buckets are ranges of the fingerprint, so one sort of 64-bit keys orders both. ``narrow`` keeps
    31 bits of the value besides the bucket; ``keep_first`` makes ``first`` the first occurrence.
    """

    def __init__(self, h: np.ndarray, n_buckets: int, narrow: bool = False, keep_first: bool = False):
        edges = np.arange(n_buckets + 1, dtype=np.uint64)
        bucket = ((h >> U64(32)) * U64(n_buckets)) >> U64(32)
        key = ((bucket << U64(32)) | (h & U64(0xFFFFFFFF))) & ~U64(1) if narrow else h & ~U64(1)
        order = np.argsort(key, kind="stable" if keep_first else None)
        v = key[order]
        new = np.ones(len(v), bool)
        new[1:] = v[1:] != v[:-1]
        at = np.flatnonzero(new)
        self.first = order[at]
        self.inverse = np.empty(len(v), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        self.count = np.diff(np.append(at, len(v)))
        values = v[at]
        own = values >> U64(32) if narrow else ((values >> U64(32)) * U64(n_buckets)) >> U64(32)
        self.bounds = np.searchsorted(own, edges)
        self.values = values.astype(np.uint32) if narrow else values

    def flagged(self) -> np.ndarray:
        """Values with the lowest bit set on those found twice or more in the block."""
        return self.values | (self.count > 1).astype(self.values.dtype)

    def bits(self, answers: dict[int, bytes]) -> np.ndarray:
        """One flag for each distinct key, from the packed bits of each bucket."""
        out = np.zeros(len(self.values), bool)
        for b, raw in answers.items():
            i, j = self.bounds[b], self.bounds[b + 1]
            out[i:j] = np.unpackbits(np.frombuffer(raw, np.uint8), count=j - i).astype(bool)
        return out


def bucket_runs(blobs: pa.ChunkedArray, kind, keep_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds of each block's values, order, run starts, run lengths, whether a run repeats) of one bucket."""
    buf, off = column_bytes(blobs)
    raw = np.frombuffer(buf.tobytes(), kind)
    value = raw & ~kind(1)
    order = np.argsort(value, kind="stable" if keep_first else None)
    first, count = runs(value[order])
    many = (count > 1) | ((np.bitwise_or.reduceat(raw[order], first) & kind(1)) > 0) if len(first) else np.zeros(0, bool)
    return off // raw.itemsize, order, first, count, many


def packed_bits(flags: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    return [np.packbits(flags[i:j]).tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
