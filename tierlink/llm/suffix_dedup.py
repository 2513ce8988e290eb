"""Substring dedup by a distributed difference-cover suffix algorithm, cut at a fixed depth.

A byte goes when a string of ``min_len`` bytes that covers it also starts anywhere else. Only
equality of ``min_len``-byte prefixes matters, so the difference-cover suffix sort (DC3 and its
generalisation DCv) stops at that depth:

1. *Sort sampled tuples.* Each document is sampled at positions whose residue modulo ``v`` is in
   a perfect difference cover D. For any two positions i, j some shift d < v puts both i + d and
   j + d in the sample. Tuples of ``t = min_len - v + 1`` bytes at sampled positions are sorted
   and named; if the strings at i and j agree on ``min_len`` bytes, the tuples at i + d, j + d
   lie inside them and get one name. With v = 133 and \\|D\\| = 12, 9 % of positions are sampled.
2. *Recurse on names.* A sampled suffix with a name of its own differs from all others and is
   final. The rest go on: only positions within v - 1 before a repeated name stay.
   Content-defined chunks are named along the way: positions inside a chunk of ``min_len`` bytes
   or more that occurs elsewhere are repeats at once, and only its first occurrence goes on.
3. *Merge the remaining suffixes.* Each position left is ordered by the name of its whole
   ``min_len``-byte prefix, composed from prefix sums in constant time.
4. *Compare adjacent prefixes.* In the sorted order equal neighbours are repeats; their windows'
   union is removed.

Names are fingerprints: 31 bits within a bucket in step 1 (a clash only keeps a position for
step 3), 63 bits in all, the bucket among them, for chunks and in step 3; bytes aren't compared again.
Among N distinct windows that reach step 3 some N^2 / 2^64 pairs have one name by accident: none to be
expected up to 100 TB / 20,000, about one window in two million at 100 TB if a tenth of all get there.
Sorting runs in blocks and buckets (see ``_blocks``): no task holds a group of copies, only one entry
of it for each block. All suffixes in full order, as the algorithm gives them, aren't needed: whether
prefixes of ``min_len`` bytes are equal is all that counts.

Defined cases: nulls and empty texts have no bytes to remove; repeated rows (also of one id) count as
separate documents; an empty table gives an empty result; all places of a repeated string go alike, so
there are no ties; input columns named as a result are replaced, others pass through. A document is worked on whole, so memory grows with the longest document, not with
the number of its copies. The input is read once into compressed blocks; see ``_blocks`` for what
that asks of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.llm._blocks import BLOB, BLOCK, BLOCK_BYTES, BUCKET, Sent, bucket_runs, buckets_for, in_blocks, packed_bits, unpack
from tierlink.llm._bytes import U64, Fingerprints, binary_rows, column_bytes, releasing
from tierlink.llm._columns import without

# Perfect difference covers (modulus, residues).
COVERS = {
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
CHUNK_GRAM, CHUNK_BITS, CHUNK_SPAN = 24, 6, 8  # a cut every 64 bytes or so; a chunk spans 8 of them
SENT = f"{BUCKET} int, {BLOCK} long, names binary, chunks binary"
ANSWER = f"{BLOCK} long, {BUCKET} int, names binary, chunks binary, first binary"
#: Result columns; input columns of these names are replaced.
RESULT = ("n_bytes", "n_removed", "n_spans", "kept")


def cover_for(min_len: int) -> tuple[int, tuple[int, ...]]:
    """Largest cover that leaves tuples of at least a third of the string."""
    fits = [v for v in COVERS if min_len - v + 1 >= max(16, min_len // 3)]
    return (max(fits), COVERS[max(fits)]) if fits else (1, (0,))


class Block:
    """The steps over one block's texts; each is a function of the texts and the answers so far."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, min_len: int, n_buckets: int):
        self.buf, self.off, self.min_len, self.n_buckets = buf, off, min_len, n_buckets
        self.v, cover = cover_for(min_len)
        self.t = min_len - self.v + 1
        self.prints = Fingerprints(buf)
        size = np.diff(off)
        inner = np.arange(len(buf), dtype=np.int32) - np.repeat(off[:-1], size).astype(np.int32)
        self.left = np.repeat(size, size).astype(np.int32) - inner  # bytes to the document's end
        hit = np.zeros(self.v, bool)
        hit[list(cover)] = True
        self.pos = np.flatnonzero(hit[inner % self.v] & (self.left >= self.t))
        self.begin = (self.pos - inner[self.pos]).astype(np.int64)  # of the position's document

    def tuples(self) -> Sent:
        return Sent(self.prints.of(self.pos, self.pos + self.t), self.n_buckets, narrow=True)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, Sent]:
        """(start, end, names) of the content-defined chunks of ``min_len`` bytes or more."""
        cut = np.flatnonzero(self.prints.every(CHUNK_GRAM) >> U64(64 - CHUNK_BITS) == 0)
        cut = cut[self.left[cut] >= CHUNK_GRAM]
        start, end = cut[:-CHUNK_SPAN], cut[CHUNK_SPAN:]
        ok = (end - start >= self.min_len) & (end - start < self.left[start])
        start, end = start[ok], end[ok]
        return start, end, Sent(self.prints.of(start, end), self.n_buckets, keep_first=True)

    def windows(self, names: dict[int, bytes], chunks: dict[int, bytes], firsts: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, Sent]:
        """(starts known to repeat, starts left, their names) once the first answers are in."""
        n = len(self.buf)
        sent = self.tuples()
        again = sent.bits(names)[sent.inverse]
        pos, begin = self.pos[again], self.begin[again]
        mark = np.zeros(n + 1, np.int32)
        np.add.at(mark, np.maximum(pos - (self.v - 1), begin), 1)
        np.add.at(mark, pos + 1, -1)
        left = np.cumsum(mark[:-1]) > 0
        start, end, sent = self.chunks()
        repeats = sent.bits(chunks)
        known = self._inside(start, end, repeats[sent.inverse])
        first = np.zeros(len(start), bool)  # first occurrences of all: they stand for the others
        first[sent.first] = sent.bits(firsts)
        stay = left & (~known | self._inside(start, end, first)) & (self.left >= self.min_len)
        on = np.flatnonzero(stay)
        return np.flatnonzero(known), on, Sent(self.prints.of(on, on + self.min_len), self.n_buckets)

    def _inside(self, start: np.ndarray, end: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Window starts whose window lies in one of those chunks."""
        mark = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(mark, start[which], 1)
        np.add.at(mark, end[which] - self.min_len + 1, -1)
        return np.cumsum(mark[:-1]) > 0

    def removed(self, starts: list[np.ndarray]) -> np.ndarray:
        mark = np.zeros(len(self.buf) + 1, np.int32)
        for s in starts:
            np.add.at(mark, s, 1)
            np.add.at(mark, s + self.min_len, -1)
        return np.cumsum(mark[:-1]) > 0


def sent_rows(block: int, names: Sent, chunks: Sent | None, n_buckets: int) -> pa.Table:
    """One row for each bucket that gets anything."""
    cuts = [names.bounds, chunks.bounds if chunks else np.zeros(n_buckets + 1, np.int64)]
    used = np.flatnonzero(sum(np.diff(c) for c in cuts))
    blobs = [binary_rows(x.flagged() if x else np.zeros(0, U64), c).take(pa.array(used)) for x, c in zip((names, chunks), cuts, strict=True)]
    return pa.table({BUCKET: pa.array(used, pa.int32()), BLOCK: pa.array(np.full(len(used), block), pa.int64()), "names": blobs[0], "chunks": blobs[1]})


def answers(kind):
    """Step over one bucket: sort the names, compare neighbours, answer each block in bits."""

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by(BLOCK)
        out = []
        for column, k in (("names", kind), ("chunks", U64)):
            bounds, order, first, count, many = bucket_runs(t.column(column), k, keep_first=column == "chunks")
            flags, leads = np.zeros(len(order), bool), np.zeros(len(order), bool)
            flags[order] = np.repeat(many, count)
            leads[order[first]] = many
            out += [packed_bits(flags, bounds)] + ([packed_bits(leads, bounds)] if column == "chunks" else [])
        return pa.table({BLOCK: t.column(BLOCK), BUCKET: t.column(BUCKET), "names": pa.array(out[0], pa.binary()), "chunks": pa.array(out[1], pa.binary()), "first": pa.array(out[2], pa.binary())})

    return releasing(merge)


def by_bucket(t: pa.Table, column: str) -> dict[int, bytes]:
    return dict(zip(t.column(BUCKET).to_pylist(), t.column(column).to_pylist(), strict=True))


def suffix_dedup(docs: DataFrame, text: str = "text", min_len: int = 200, block_bytes: int = BLOCK_BYTES, characters: bool = False) -> DataFrame:
    """``docs`` plus ``n_bytes, n_removed, n_spans`` (long) and ``kept`` (binary: the bytes that stay).

    ``characters``: a character that loses a byte goes whole, so ``kept`` is text.
    """
    docs = without(docs, RESULT)
    n_buckets = buckets_for(docs, text, block_bytes)

    def opened(t: pa.Table) -> tuple[pa.Table, Block]:
        rows = unpack(t.column(BLOB)[0].as_py())
        return rows, Block(*column_bytes(rows.column(text)), min_len, n_buckets)

    def name_samples(t: pa.Table) -> pa.Table:
        _, block = opened(t)
        return sent_rows(t.column(BLOCK)[0].as_py(), block.tuples(), block.chunks()[2], n_buckets)

    def name_windows(key, t: pa.Table, first: pa.Table) -> pa.Table:
        _, block = opened(t)
        _, _, windows = block.windows(*(by_bucket(first, c) for c in ("names", "chunks", "first")))
        return sent_rows(key[0].as_py(), windows, None, n_buckets)

    def cut(key, t: pa.Table, replies: pa.Table) -> pa.Table:
        rows, block = opened(t)
        second = np.array(replies.column("second").to_pylist(), bool)
        first, last = replies.filter(pa.array(~second)), replies.filter(pa.array(second))
        known, left, windows = block.windows(*(by_bucket(first, c) for c in ("names", "chunks", "first")))
        gone = block.removed([known, left[windows.bits(by_bucket(last, "names"))[windows.inverse]]])
        if characters and gone.any():
            own = np.cumsum((block.buf & 0xC0) != 0x80) - 1  # the character of each byte
            gone = np.bincount(own, gone)[own] > 0
        off = block.off
        total = np.concatenate([[0], np.cumsum(gone)])
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        starts = off[:-1][off[:-1] < len(gone)]
        opens[starts] = gone[starts]
        spans = np.concatenate([[0], np.cumsum(opens)])
        for name, value in (("n_bytes", np.diff(off)), ("n_removed", total[off[1:]] - total[off[:-1]]), ("n_spans", spans[off[1:]] - spans[off[:-1]])):
            rows = rows.append_column(name, pa.array(value, pa.int64()))
        return rows.append_column("kept", binary_rows(block.buf[~gone], off - total[off]))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    blocks = in_blocks(docs, text, block_bytes).groupBy(BLOCK)
    first = blocks.applyInArrow(releasing(name_samples), SENT).groupBy(BUCKET).applyInArrow(answers(np.uint32), ANSWER)
    second = blocks.cogroup(first.groupBy(BLOCK)).applyInArrow(releasing(name_windows), SENT).groupBy(BUCKET).applyInArrow(answers(U64), ANSWER)
    replies = first.withColumn("second", F.lit(False)).unionByName(second.withColumn("second", F.lit(True)))
    return blocks.cogroup(replies.groupBy(BLOCK)).applyInArrow(releasing(cut), f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``suffix_dedup`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = suffix_dedup(docs)
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
