"""Best rows of a stream for blocks of queries, and tasks of bounded size that pair two tables.

A block of queries stays in a task while the index rows pass in batches. Matrix products only screen: what may
belong to a query's best by them is worked out anew by differences, so results don't depend on the products' rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES = 16384  # of a task at most; they are all in memory
ROWS = 131072  # of the index that pass through a task at most; they aren't held
TASKS = 24  # that are aimed at if the tables are small
CELLS = 1 << 22  # numbers of one screening product
EXACT = 1 << 15  # pairs that are worked out at once


def matrix(col: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """[row, dim] of a list column; vectors of different sizes are an error."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pc.unique(pc.list_value_length(col)).to_pylist()
    if len(size) > 1 or (dims is not None and size and size[0] != dims):
        raise ValueError(f"vectors of {sorted(x or 0 for x in size)} numbers, {dims or 'one size'} expected")
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


class Closest:
    """The ``k`` rows of largest score of each query, by name among scores equal to nine digits.

    Scores are minus squared distances (``l2``), normalised products (``cosine``) or products (``dot``). Memory is
    in proportion to the queries, however many rows pass.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str = "l2") -> None:
        self.metric, self.k = metric, k
        self.q = unit(queries) if metric == "cosine" else queries
        self.norm = (self.q * self.q).sum(1)
        self.bar = np.full(len(self.q), -np.inf)  # the k-th score, as soon as there is one
        self.row, self.score, self.name = np.zeros(0, np.int64), np.zeros(0), None
        self.step = max(k, 16)

    def add(self, x: np.ndarray, names: np.ndarray, seen: Callable[[slice], np.ndarray] | None = None) -> None:
        """``seen``: of a slice of the rows, which queries [query, row] they count for."""
        if self.metric == "cosine":
            x = unit(x)
        at = 0
        while at < len(x):
            own = slice(at, at + self.step)
            self._part(x[own], names[own], seen(own) if seen else None)
            at += self.step
            self.step = min(2 * self.step, max(16, CELLS // max(1, len(self.q))))  # short at first, while nearly all rows are among the best

    def _part(self, x: np.ndarray, names: np.ndarray, seen: np.ndarray | None) -> None:
        norm = (x * x).sum(1)
        screen = self.q @ x.T
        bar = self.bar - 0.51e-9
        if self.metric == "l2":
            screen *= 2
            screen -= norm
            bar = bar + self.norm
        # what rounding of the products may hide
        bar = bar - 4e-16 * (x.shape[1] + 4) * (self.norm + norm.max(initial=0.0))
        hit = screen >= bar[:, None]
        if seen is not None:
            hit &= seen
        i, j = np.nonzero(hit)
        for lo in range(0, len(i), 1 << 20):
            self._merge(i[lo : lo + (1 << 20)], j[lo : lo + (1 << 20)], x, names)

    def _merge(self, i: np.ndarray, j: np.ndarray, x: np.ndarray, names: np.ndarray) -> None:
        score = np.concatenate([self._exact(self.q[i[a : a + EXACT]], x[j[a : a + EXACT]]) for a in range(0, len(i), EXACT)])
        self.take(i, score, names[j])

    def take(self, i: np.ndarray, score: np.ndarray, names: np.ndarray) -> None:
        """Scores of queries ``i`` with the rows ``names``, of which the best are kept."""
        good = np.round(score, 9) >= self.bar[i]
        i, names, score = i[good], names[good], score[good]
        if not len(i):
            return
        touched = np.zeros(len(self.q), bool)
        touched[i] = True
        again = touched[self.row]
        held = self.name if self.name is not None else names[:0]
        row, new, name = np.concatenate([self.row[again], i]), np.concatenate([self.score[again], score]), np.concatenate([held[again], names])
        rounded = np.round(new, 9)
        order = np.lexsort((name, -rounded, row))
        first = np.flatnonzero(np.r_[True, np.diff(row[order]) > 0])
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        keep, last = order[rank < self.k], order[rank == self.k - 1]
        self.bar[row[last]] = rounded[last]
        self.row, self.score, self.name = np.concatenate([self.row[~again], row[keep]]), np.concatenate([self.score[~again], new[keep]]), np.concatenate([held[~again], name[keep]])

    def _exact(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        return -((x - q) ** 2).sum(1) if self.metric == "l2" else (q * x).sum(1)

    def table(self, queries: pa.Array, name: pa.DataType) -> pa.RecordBatch:
        """(q, name, score) of what was found."""
        found = pa.array(self.name if self.name is not None else [], name)
        return pa.RecordBatch.from_arrays([queries.take(pa.array(self.row)), found, pa.array(self.score)], names=["q", "name", "score"])


class Phrases:
    """Late interaction: the ``k`` names of largest score of each query, the sum over its tokens of the best product with a name's rows.

    ``vectors`` are those of the pairs of ``q`` and ``token``. Rows pass in order of their names; besides those that are kept, only
    the best products of the name that is open are held, so a name may have any number of rows.
    """

    def __init__(self, vectors: np.ndarray, q: np.ndarray, token: np.ndarray, k: int) -> None:
        order = np.lexsort((token, q))
        q, token = q[order], token[order]
        fresh = np.r_[True, q[1:] != q[:-1]]
        self.q = vectors[order]
        self.tokens = np.flatnonzero(fresh | np.r_[True, token[1:] != token[:-1]])  # a token of several rows counts once
        self.starts = np.flatnonzero(fresh[self.tokens])
        self.ids = q[fresh]
        self.best = Closest(np.zeros((len(self.ids), 1)), k, "dot")
        self.open, self.top = None, None

    def add(self, x: np.ndarray, names: np.ndarray) -> None:
        step = max(1, CELLS // len(self.q))
        for at in range(0, len(x), step):
            own = names[at : at + step]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            top, named = np.maximum.reduceat(self.q @ x[at : at + step].T, first, axis=1), own[first]
            if self.top is not None:
                if named[0] == self.open:
                    np.maximum(top[:, 0], self.top, out=top[:, 0])
                else:
                    top, named = np.column_stack([self.top, top]), np.concatenate([np.array([self.open], named.dtype), named])
            self._close(top[:, :-1], named[:-1])
            self.open, self.top = named[-1], top[:, -1].copy()

    def _close(self, top: np.ndarray, names: np.ndarray) -> None:
        if top.shape[1]:
            score = np.add.reduceat(np.maximum.reduceat(top, self.tokens, axis=0), self.starts, axis=0)
            i, j = np.nonzero(score >= self.best.bar[:, None] - 0.51e-9)
            for lo in range(0, len(i), 1 << 20):
                self.best.take(i[lo : lo + (1 << 20)], score[i[lo : lo + (1 << 20)], j[lo : lo + (1 << 20)]], names[j[lo : lo + (1 << 20)]])

    def finish(self) -> Closest:
        if self.top is not None:
            self._close(self.top[:, None], np.array([self.open]))
            self.top = None
        return self.best


# -- tasks ------------------------------------------------------------------------------------------
def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Runs of rows with equal keys, cut at batches, of batches that are ordered by them."""
    for batch in batches:
        if batch.num_rows:
            marks = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                yield tuple(marks[:, lo].tolist()), batch.slice(lo, hi - lo)


def number_of_parts(queries: int, rows: int, block: int) -> tuple[int, int]:
    """(blocks of queries, slices of the index): tasks of bounded size, and some even of small tables, none of under ``block`` rows."""
    blocks = max(1, -(-queries // QUERIES))
    slices = max(-(-rows // ROWS), min(-(-TASKS // blocks), rows // block), 1)
    return blocks, slices


def paired(queries: DataFrame, index: DataFrame, block_of: Column, blocks_of: Column, slices: int, tasks: int) -> DataFrame:
    """(task, side, q, name, cell, v) in partitions of whole tasks, a task's queries (q, v) before its index rows (name, cell, v).

    ``block_of``: number of a query's block; ``blocks_of``: the blocks that an index row meets, an array.
    """
    name, q = index.schema["name"].dataType, queries.schema["q"].dataType
    every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    left = queries.select(block_of.cast("int").alias("b"), every.alias("s"), F.lit(0).alias("side"), "q", F.lit(None).cast(name).alias("name"), F.lit(0).alias("cell"), "v")
    right = index.select(F.explode(blocks_of).alias("b"), F.pmod(F.xxhash64("name"), F.lit(slices)).cast("int").alias("s"), F.lit(1).alias("side"), F.lit(None).cast(q).alias("q"), "name", "cell", "v")
    both = left.unionByName(right).select((F.col("b") * slices + F.col("s")).alias("task"), "side", "q", "name", "cell", "v")
    return both.repartition(tasks, "task").sortWithinPartitions("task", "side", "name")


def best_in_tasks(pairs: DataFrame, k: int, metric: str, seen: Callable[[np.ndarray], np.ndarray] | None = None, dims: int | None = None) -> DataFrame:
    """(q, name, score) of each task of ``paired``, ``k`` rows a query at most. ``seen``: of query vectors, which cells [query, cell] they look into."""
    q, name = dict(pairs.dtypes)["q"], dict(pairs.dtypes)["name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(segments(batches, ["task", "side"]), key=lambda part: part[0][0]):
            held, ids, best, open_ = [], None, None, None
            for (_, side), part in parts:
                if side == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # index rows without a query
                if best is None:
                    own = pa.Table.from_batches(held)
                    ids, vectors = own.column("q").combine_chunks(), matrix(own.column("v"), dims)
                    best, open_ = Closest(vectors, k, metric), seen(vectors) if seen else None
                x = matrix(part.column("v"), best.q.shape[1])
                cell = part.column("cell").to_numpy()
                best.add(x, part.column("name").to_numpy(zero_copy_only=False), (lambda at: open_[:, cell[at]]) if seen else None)
            if best is not None and best.name is not None:
                yield best.table(ids, part.column("name").type)

    return pairs.mapInArrow(run, f"q {q}, name {name}, score double")


def phrases_in_tasks(pairs: DataFrame, k: int, q: str) -> DataFrame:
    """(q, name, score) of each task of ``paired``, whose q is a struct of q, of type ``q``, and token: ``k`` names a query at most by late interaction."""
    name = dict(pairs.dtypes)["name"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in groupby(segments(batches, ["task", "side"]), key=lambda part: part[0][0]):
            held, best = [], None
            for (_, side), part in parts:
                if side == 0:
                    held.append(part)
                    continue
                if not held:
                    continue  # index rows without a query
                if best is None:
                    own = pa.Table.from_batches(held)
                    key = own.column("q").combine_chunks()
                    best = Phrases(matrix(own.column("v")), *[key.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], k)
                    kind = key.field(0).type
                best.add(matrix(part.column("v"), best.q.shape[1]), part.column("name").to_numpy(zero_copy_only=False))
            if best is not None:
                yield best.finish().table(pa.array(best.ids, kind), part.column("name").type)

    return pairs.mapInArrow(run, f"q {q}, name {name}, score double")
