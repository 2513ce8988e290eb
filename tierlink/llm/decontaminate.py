"""Benchmark decontamination by CGK walks, bit-sampling LSH and exact edit verification.

Texts are sequences of words (ASCII lower case). A document leaks an item of n words if one of its
windows of n words has a word edit distance of at most ``floor(rate * n)`` to the item. With
``free_ends`` (the queries) the window may have any length, so words dropped inside a passage or cut
off by the document's ends cost one each; such windows lie in windows of ``floor(rate * n)`` more
words, or fewer at a document's end, to which the filter below applies.

1. *Count filter.* A window that close keeps at least n - 1 - 2 * floor(rate * n) of the item's
   word pairs. Windows with fewer pairs known from any item, each counted as often as an item has
   one at most, are skipped; this loses nothing.
2. *Embedding.* From the starts that are left (with free ends each second of those in a row, for items of
   24 words or more), the n words that follow (an item-sized window) are read
   by CGK random walks: a walk puts out a word a step and moves on or stays by a coin that the word
   and the step decide, so sequences of small edit distance come out with small Hamming distance.
3. *Bit sampling.* A key is some sampled coordinates of a walk; windows and items that share a key of
   one of the tables are candidates. The numbers of walks, tables and sampled coordinates follow from
   the item's length and ``recall``: pairs at the limit of distance are drawn (replaced, added and
   dropped words, and all three), and the cheapest plan whose chance to miss such a pair is at most
   1 - ``recall`` for each kind is taken (``plan_for``). Closer pairs are missed less.
4. *Verification* by the exact edit distance; with free ends, of candidates that hold enough of that
   item's word pairs, one pass over the words around them finds the nearest passage there.

Items of under ``min_words`` words are matched exactly, by hashes of as many words.

The items are the stated query set: they go to the tasks in chunks of at most ``chunk_words``
words, one pass each, so no chunk grows with the benchmark. Documents aren't shuffled.

Defined cases: null or empty texts leak nothing; null or empty items are not searched; an empty table
on either side gives no leak; repeated rows get the same result each; of equally near windows the
first counts, then the shortest; a column ``leaks`` is replaced, other columns pass through; long
texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.llm._bytes import LOWER, U64, Fingerprints, column_bytes, mix, releasing, row_slices, words
from tierlink.llm._columns import without

RATE = 0.2
RECALL = 0.999
WALKS = (2, 3, 4, 6, 8, 12, 16)
TABLES = (2, 4, 8, 16, 32)  # of each walk
BITS = (8, 6, 5, 4, 3, 2, 1)
STRANGERS, VERIFY, STEP = 0.05, 200.0, 0.15  # agreement of a coordinate by accident; cost of a verification and of a walk's step, in keys
DRAWN = 120  # pairs of each kind that a plan is chosen on
PLANNED = 1024  # words; no plan is looked for beyond, as none fits from some 800 on
CELLS = 4_000_000  # numbers of an array of windows
MIN_WORDS = 5
SPAN = 9
SLICE_BYTES = 2 << 20
MEETINGS = 2_000_000
LEAK = pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("n_words", pa.int32()), ("word_start", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])
LEAK_SQL = "array<struct<item_id:bigint,distance:int,n_words:int,word_start:bigint,byte_start:bigint,byte_end:bigint>>"


def pair_hash(word: np.ndarray) -> np.ndarray:
    return mix(word[:-1] * U64(0x9E3779B97F4A7C15) + word[1:])


def with_item(pair: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(pair ^ ((item.astype(U64) + U64(1)) * U64(0xC2B2AE3D27D4EB4F)))


def embed(seq: np.ndarray, walks: int, columns: np.ndarray) -> np.ndarray:
    """[column, walk, window]: coordinates ``columns`` (sorted) of the CGK walks over each row of ``seq`` [window, n]."""
    rows, n = seq.shape
    flat = np.concatenate([seq, np.zeros((rows, 1), U64)], axis=1).ravel()  # past the end a walk reads 0
    at = np.zeros((walks, rows), np.int32) + (np.arange(rows, dtype=np.int32) * (n + 1))
    last = np.arange(rows, dtype=np.int32) * (n + 1) + n
    out = np.empty((len(columns), walks, rows), U64)
    k = 0
    coin = mix(np.arange(1, walks * (int(columns[-1]) + 1) + 1, dtype=np.uint64)).reshape(-1, walks, 1) | U64(1)
    for step in range(int(columns[-1]) + 1):
        sym = flat[at]
        while k < len(columns) and columns[k] == step:
            out[k] = sym
            k += 1
        sym += coin[step] << U64(1)  # an odd number of the step keeps the coins of its symbols apart
        sym *= coin[step]
        sym ^= sym >> U64(29)
        sym *= U64(0xBF58476D1CE4E5B9)
        at += (sym >> U64(63)).astype(np.int32)
        np.minimum(at, last, out=at)
    return out


def table_keys(seq: np.ndarray, walks: int, tables: int, bits: int) -> np.ndarray:
    """[window, walk * table] LSH keys of windows of one length."""
    n = seq.shape[1]
    rng = np.random.default_rng(1000 * n)
    chosen = rng.integers(0, 2 * n, (walks, tables, bits))  # a walk has read most of the text by step 2n
    factor = mix(np.arange(1, walks * tables * bits + 1, dtype=np.uint64)).reshape(chosen.shape) | U64(1)
    columns = np.unique(chosen)
    out = embed(seq, walks, columns)
    place = np.searchsorted(columns, chosen)
    keys = np.zeros((walks * tables, len(seq)), U64)
    for walk in range(walks):
        for t in range(tables):
            own = keys[walk * tables + t]
            for j in range(bits):  # coordinates are hashes, so sums of multiples tell keys apart
                own += out[place[walk, t, j], walk] * factor[walk, t, j]
    return keys.T


def edited(rng: np.random.Generator, n: int, most: int, kind: str, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A sequence of n distinct symbols, and the first n of it after ``most`` edits, with ``lead`` others before and more behind."""
    item = rng.integers(1, 1 << 62, n, dtype=np.uint64)
    kinds = ("replace", "insert", "delete") if kind == "all" else (kind,)
    out = item.tolist()
    for k in np.sort(rng.choice(n, most, replace=False))[::-1].tolist():  # from the end on, so places hold
        new = int(rng.integers(1, 1 << 62))
        how = kinds[int(rng.integers(len(kinds)))]
        out[k : k + 1] = {"replace": [new], "insert": [out[k], new], "delete": []}[how]
    out = rng.integers(1, 1 << 62, lead, dtype=np.uint64).tolist() + out + rng.integers(1, 1 << 62, n, dtype=np.uint64).tolist()
    return item, np.array(out[:n], np.uint64)


@cache
def agreement(n: int, most: int, walks: int, lead: int) -> np.ndarray:
    """[kind, pair, walk] share of a walk's coordinates that agree, over drawn pairs at distance ``most``."""
    rng = np.random.default_rng(n)
    columns = np.arange(2 * n)
    out = []
    for kind in ("replace", "insert", "delete", "all"):
        a, b = (np.stack(x) for x in zip(*(edited(rng, n, most, kind, lead) for _ in range(DRAWN)), strict=True))
        out.append((embed(a, walks, columns) == embed(b, walks, columns)).mean(0).T)
    return np.stack(out)


@cache
def plan_for(n: int, rate: float, recall: float, lead: int = 0) -> tuple[int, int, int] | None:
    """(walks, tables of each, sampled coordinates) of the cheapest plan that reaches the recall at the limit of distance.

    None if no plan does, as for items of about 800 words and more, or with a recall of 1: such items are
    searched exactly, by the count filters, which lose nothing, and verification.

    A plan costs the steps of its walks, its keys, and the verification of strangers: those that agree
    in each coordinate with probability ``STRANGERS``. Half the misses allowed are kept in reserve, as
    drawn pairs are a sample. ``lead``: words by which a window may begin before the passage.
    """
    most = int(rate * n)
    if recall >= 1 or n > PLANNED:
        return None
    if not most and not lead:
        return 1, 1, 8  # equal windows have equal keys
    share = agreement(n, most, max(WALKS), lead)
    plans = sorted((w * 2 * n * STEP + w * t * (1 + 0.15 * b) + VERIFY * min(1.0, w * t * STRANGERS**b), w, t, b) for w in WALKS for t in TABLES for b in BITS)
    for _, w, t, b in plans:
        missed = np.exp(np.log1p(-np.minimum(share[:, :, :w] ** b, 1 - 1e-12)).sum(2) * t).mean(1).max()
        if missed <= (1 - recall) / 2:
            return w, t, b
    return None


def at_a_time(width: int, most: int = 20_000) -> int:
    """Rows of that width in an array of bounded size."""
    return max(1, min(most, CELLS // max(1, width)))


def lead_of(n: int, free_ends: bool) -> int:
    """Words that windows for items of n words may begin before a passage: of neighbouring starts only some are read."""
    return int(free_ends and n >= 24)


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distance of each row of ``a`` to that row of ``b`` ([pair, words] each)."""
    pairs, m = a.shape
    n = b.shape[1]
    step = np.arange(n + 1)
    row = np.broadcast_to(step, (pairs, n + 1)).copy()
    for i in range(m):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (a[:, i : i + 1] != b))
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row[:, -1]


def nearest_passages(texts: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, start, end) of the passage of each text nearest to that item: first of equals, then shortest."""
    size, need = np.array([len(x) for x in texts]), np.array([len(x) for x in items])
    a, b = np.zeros((len(texts), size.max()), U64), np.zeros((len(texts), need.max()), U64)
    for i, (x, y) in enumerate(zip(texts, items, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    one = np.int64(1 << 40)  # distances above, starts below
    step = np.arange(b.shape[1] + 1) * one
    row = np.broadcast_to(step, (len(a), len(step))).copy()
    best, end, each = np.full(len(a), np.iinfo(np.int64).max), np.zeros(len(a), np.int64), np.arange(len(a))
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, 1:] + one, row[:, :-1] + (a[:, i : i + 1] != b) * one)
        row = np.minimum.accumulate(new - step, axis=1) + step
        code = row[each, need]
        better = (code < best) & (i < size)
        best[better], end[better] = code[better], i + 1
    return best // one, best % one, end


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in a row."""
    h = word[: max(0, len(word) - n + 1)]
    for j in range(1, n):
        h = mix(h * U64(0x9E3779B97F4A7C15) + word[j : j + len(h)])
    return h


class Index:
    """Items of one chunk by word count, with their known pairs and the keys of their tables."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float, min_words: int = MIN_WORDS, free_ends: bool = False, recall: float = RECALL, plans: dict[int, tuple[int, int, int] | None] | None = None):
        self.short = {}
        for n in sorted({len(w) for _, w in items if len(w) < min_words}):
            own = [(i, w) for i, w in items if len(w) == n]
            h = np.concatenate([grams(w, n) for _, w in own])
            order = np.argsort(h, kind="stable")
            self.short[n] = h[order], np.array([i for i, _ in own])[order]
        items = [(i, w) for i, w in items if len(w) >= min_words]
        self.free_ends = free_ends
        pairs = [pair_hash(w) for _, w in items]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, U64)
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.pairs & U64((1 << 20) - 1)).astype(np.int64)] = True
        self.sizes, self.item_pairs = {}, {}
        self.cap = max((int(np.unique(p, return_counts=True)[1].max()) for p in pairs), default=1)
        for n in sorted({len(w) for _, w in items}):
            own = [(i, w) for i, w in items if len(w) == n]
            seq = np.stack([w for _, w in own])
            plan = plans[n] if plans else plan_for(n, rate, recall, lead_of(n, free_ends))
            keys = table_keys(seq, *plan) if plan else np.zeros((len(seq), 1), U64)
            order = np.argsort(keys, axis=None, kind="stable")
            self.item_pairs[n] = np.unique(with_item(pair_hash(seq.T).T, np.arange(len(own))[:, None]))
            known = np.zeros(1 << 16, bool)
            known[keys.ravel() >> U64(48)] = True
            self.sizes[n] = (np.array([i for i, _ in own]), seq, plan, known, keys.ravel()[order], order // keys.shape[1], int(rate * n))

        self.least = min((-(-max(1, n - 1 - 2 * int(rate * n)) // -(-(self.reach(n) - 1) // SPAN)) for n in self.sizes), default=1)

    def reach(self, n: int) -> int:
        """Words of the windows that are counted for items of n words."""
        return n + self.sizes[n][-1] if self.free_ends else n

    def exact(self, word: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, item ids, first words) of the first copy of each short item in each document."""
        for n, (known, ids) in self.short.items():
            h = grams(word, n)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            first = np.flatnonzero((known[at] == h) & (doc[: len(h)] == doc[n - 1 :])) if len(h) else np.zeros(0, np.int64)
            _, i = np.unique(np.stack([doc[first], at[first]]), axis=1, return_index=True)
            first = first[i]
            count = np.searchsorted(known, h[first], "right") - at[first]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            yield n, ids[np.repeat(at[first], count) + inner], np.repeat(first, count)

    def known_pairs(self, word: np.ndarray) -> np.ndarray:
        h = pair_hash(word)
        hit = self.bitmap[(h & U64((1 << 20) - 1)).astype(np.int64)]
        on = np.flatnonzero(hit)
        at = np.searchsorted(self.pairs, h[on])
        at[at == len(self.pairs)] = 0
        hit[on] = self.pairs[at] == h[on]
        return hit

    def candidates(self, word: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(n, first words of the windows of ``reach(n)`` words that the count filter leaves)."""
        if len(word) < 2 or not self.sizes:
            return
        hit = self.known_pairs(word) & (doc[1:] == doc[:-1])
        total = np.concatenate([[0], np.cumsum(hit)])
        # some SPAN neighbouring pairs of a window hold their share of the pairs it needs
        upto = np.minimum(np.arange(len(hit)) + SPAN, len(hit))
        dense = np.flatnonzero(total[upto] - total[:-1] >= self.least)
        reach = max(map(self.reach, self.sizes))
        mark = np.zeros(len(word) + 1, np.int32)
        np.add.at(mark, np.maximum(dense - reach, 0), 1)
        np.add.at(mark, dense + 1, -1)
        near = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        if not len(near):
            return
        pair = pair_hash(word)
        last = np.searchsorted(doc, doc, "right") - 1  # last word of each word's document
        for n, (*_, most) in self.sizes.items():
            need, m = max(1, n - 1 - 2 * most), self.reach(n)
            if self.free_ends:
                first = near[total[np.minimum(near + m - 1, last[near])] - total[near] >= need]
            else:
                first = near[near + n <= len(word)]
                first = first[(total[first + n - 1] - total[first] >= need) & (doc[first + n - 1] == doc[first])]
            step = at_a_time(m)
            for i in range(0, len(first), step):
                some = first[i : i + step]
                inside = some[:, None] + np.arange(m - 1)
                inside = np.where(inside < last[some][:, None], inside, len(hit) - 1)
                known = np.where(hit[inside] & (inside < last[some][:, None]), pair[inside], U64(0))
                known.sort(axis=1)
                extra = (known[:, self.cap :] == known[:, : -self.cap]) & (known[:, self.cap :] > 0) if m - 1 > self.cap else np.zeros((len(some), 0), bool)
                some = some[(known > 0).sum(1) - extra.sum(1) >= need]  # a pair counts as often as an item has it at most
                if len(some):
                    yield n, some

    def met(self, n: int, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, place of the item) of windows that share a key with an item of n words, or all without a plan; a pair may come twice."""
        ids, _, plan, known, keys, holder, _ = self.sizes[n]
        if plan is None:
            step = max(1, MEETINGS // len(ids))
            for at in range(0, len(windows), step):
                w, item = np.divmod(np.arange(min(step, len(windows) - at) * len(ids)), len(ids))
                yield at + w, item
            return
        walks, tables, bits = plan
        step = max(64, min(4096, (1 << 24) // (walks * tables * bits * walks)))
        for at in range(0, len(windows), step):
            own = table_keys(windows[at : at + step, :n], *plan)
            window, table = np.nonzero(known[own >> U64(48)])  # most keys are none of the items'
            own = own[window, table]
            lo = np.searchsorted(keys, own)
            hit = keys[np.minimum(lo, len(keys) - 1)] == own
            window, own, lo = window[hit], own[hit], lo[hit]
            count = np.searchsorted(keys, own, "right") - lo
            total = np.cumsum(count)
            first = 0
            while first < len(own):  # some keys at a time: lists of common keys are long
                upto = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + MEETINGS, "right")))
                c = count[first:upto]
                inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                w, item = np.divmod(np.unique(np.repeat(window[first:upto], c) * len(ids) + holder[np.repeat(lo[first:upto], c) + inner]), len(ids))
                yield at + w, item
                first = upto

    def enough(self, n: int, word: np.ndarray, first: np.ndarray, stop: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the words from ``first`` on hold as many pairs of that item as a passage within the distance does; loses nothing."""
        m, known = self.reach(n), self.item_pairs[n]
        need = n - 1 - 2 * self.sizes[n][-1] - lead_of(n, True)
        out = np.ones(len(first), bool)
        step = at_a_time(m)
        for i in range(0, len(first) if need > 0 else 0, step):
            r = slice(i, i + step)
            inside = first[r, None] + np.arange(m)
            pair = with_item(pair_hash(word[np.minimum(inside, len(word) - 1)].T).T, item[r, None])
            at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
            out[r] = ((known[at] == pair) & (inside[:, 1:] < stop[r, None])).sum(1) >= need
        return out

    def verified(self, n: int, windows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, item id, distance) of pairs within the distance, items of n words."""
        ids, seq, *_, most = self.sizes[n]
        step, need, known = at_a_time(n, 50_000), n - 1 - 2 * most, self.item_pairs[n]
        for w, item in self.met(n, windows):
            for i in range(0, len(w), step):
                x, y = w[i : i + step], item[i : i + step]
                if self.sizes[n][2] is None:
                    pair = with_item(pair_hash(windows[x].T).T, y[:, None])
                    held = known[np.minimum(np.searchsorted(known, pair), len(known) - 1)] == pair
                    some = held.sum(1) >= need
                    x, y = x[some], y[some]
                distance = edit_distances(windows[x], seq[y])
                ok = distance <= most
                yield x[ok], ids[y[ok]], distance[ok]

    def stretches(self, n: int, word: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place of the item, first word, end) of the words around windows from ``first`` on that meet an item of n words."""
        m, most = self.reach(n), self.sizes[n][-1]
        # of starts in a row each (lead + 1)-th is read: the one before a passage's own begins some words early
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1] + 1) | (doc[first[1:]] != doc[first[:-1]])
        at = np.arange(len(first))
        first = first[(at - np.maximum.accumulate(np.where(new, at, 0))) % (lead_of(n, True) + 1) == 0]
        parts = [np.zeros((3, 0), np.int64)]
        step = at_a_time(m)
        for i in range(0, len(first), step):
            some = first[i : i + step]
            begin, stop = (np.searchsorted(doc, doc[some], side) for side in ("left", "right"))
            inside = some[:, None] + np.arange(n)
            windows = np.where(inside < stop[:, None], word[np.minimum(inside, len(word) - 1)], U64(0))
            for w, item in self.met(n, windows):
                ok = self.enough(n, word, some[w], stop[w], item)
                w, item = w[ok], item[ok]
                # a passage may begin some words beside a window that met its item
                low, high = np.maximum(some - most, begin)[w], np.minimum(some + m + most + lead_of(n, True), stop)[w]
                parts.append(np.stack([item, low, high]))
        item, low, high = np.concatenate(parts, axis=1)
        order = np.lexsort((low, item))
        item, low, high = item[order], low[order], high[order]
        i = 0
        while i < len(item):
            j, end = i + 1, high[i]
            while j < len(item) and item[j] == item[i] and low[j] < end:  # of one document: stretches end with it
                end = max(end, high[j])
                j += 1
            yield int(item[i]), int(low[i]), int(end)
            i = j


def item_chunks(benchmark: DataFrame, id_col: str, text: str, chunk_words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word hashes, streamed to the driver in chunks of bounded size."""
    chunk, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        buf = LOWER[np.frombuffer(row["t"].encode(), np.uint8)]
        start, end, _ = words(buf, np.array([0, len(buf)]))
        if len(start):
            chunk.append((row["i"], Fingerprints(buf).of(start, end)))
            size += len(start)
        if size >= chunk_words:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, min_words: int = MIN_WORDS, chunk_words: int = 200_000, free_ends: bool = False, recall: float = RECALL) -> DataFrame:
    """``docs`` plus ``leaks``: for each leaked item its nearest window (first of equals).

    ``recall``: least chance to find a pair at the limit of distance; closer ones are found more often.
    """
    docs = without(docs, {"leaks"})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    place = docs.columns.index(text)
    out = docs.withColumn("leaks", F.array().cast(LEAK_SQL))
    for items in item_chunks(benchmark, item_id, item_text, chunk_words):
        plans = {n: plan_for(n, rate, recall, lead_of(n, free_ends)) for n in sorted({len(w) for _, w in items if len(w) >= min_words})}

        def run(batches: Iterator[pa.RecordBatch], items=items, plans=plans) -> Iterator[pa.RecordBatch]:
            index = Index(items, rate, min_words, free_ends, recall, plans)
            for batch in batches:
                buf, off = column_bytes(batch.column(place))
                before = batch.column(batch.num_columns - 1).to_pylist()
                found: dict[tuple[int, int], tuple] = {}
                near: list[tuple] = []

                def note(row: int, item: int, new: tuple, found=found) -> None:
                    if (row, item) not in found or new < found[row, item]:
                        found[row, item] = new

                pending: dict[int, list] = {}
                for i, j in row_slices(off, SLICE_BYTES):
                    low, o = LOWER[buf[off[i] : off[j]]], off[i : j + 1] - off[i]
                    start, end, doc = words(low, o)
                    hashes = Fingerprints(low).of(start, end)
                    base = np.searchsorted(doc, np.arange(j - i))
                    for n, ids, f in index.exact(hashes, doc):
                        d = doc[f]
                        for k, item, w, b0, b1 in zip((i + d).tolist(), ids.tolist(), (f - base[d]).tolist(), (start[f] - o[d]).tolist(), (end[f + n - 1] - o[d]).tolist(), strict=True):
                            note(k, item, (0, w, n, b0, b1))
                    for n, f in index.candidates(hashes, doc):
                        d = doc[f]
                        if free_ends:
                            for item, a, b in index.stretches(n, hashes, doc, f):
                                e = doc[a]
                                near.append((hashes[a:b], n, item, int(i + e), int(a - base[e]), start[a:b] - o[e], end[a:b] - o[e]))
                            continue
                        pending.setdefault(n, []).append((hashes[f[:, None] + np.arange(n)], i + d, f - base[d], start[f] - o[d], end[f + n - 1] - o[d]))
                for n, parts in pending.items():  # windows of all slices together: longer arrays, fewer calls
                    windows, row, first, b0, b1 = (np.concatenate(x) for x in zip(*parts, strict=True))
                    for w, ids, distance in index.verified(n, windows):
                        for k, item, e in zip(w.tolist(), ids.tolist(), distance.tolist(), strict=True):
                            note(int(row[k]), item, (e, int(first[k]), n, int(b0[k]), int(b1[k])))
                near.sort(key=lambda x: len(x[0]))
                at = 0
                while at < len(near):  # alike in length
                    part = near[at : at + 2000]
                    part = part[: at_a_time(len(part[-1][0]), 2000)]
                    at += len(part)
                    for (_, n, item, row, first, b0, b1), e, x, y in zip(part, *(v.tolist() for v in nearest_passages([p[0] for p in part], [index.sizes[p[1]][1][p[2]] for p in part])), strict=True):
                        ids, *_, most = index.sizes[n]
                        if e <= most:
                            note(row, int(ids[item]), (e, first + x, y - x, int(b0[x]), int(b1[y - 1])))
                for (row, item), (e, w, n, b0, b1) in sorted(found.items()):
                    before[row].append({"item_id": item, "distance": e, "n_words": n, "word_start": w, "byte_start": b0, "byte_end": b1})
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(before, pa.list_(LEAK))], names=batch.schema.names)

        out = out.mapInArrow(releasing(run), f"{fields}, leaks {LEAK_SQL}")
    return out


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Every (document, item) leak with its distance and place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs, benchmark, free_ends=True).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
