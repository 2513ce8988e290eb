"""Pattern packing by non-negative least squares: whole documents into as few sequences as can be.

Only the histogram of lengths decides what goes together. Patterns of one to three lengths that fill a
sequence exactly are enumerated; how often each is to be repeated is fitted to the histogram by
non-negative least squares (active set, columns of steepest descent taken in batches), rounded down and
cut back where a length is used more often than it occurs; the fit is made once more on what is left. The residual is packed by best fit, longest first, in groups of equal sequences. All this is
work on at most ``window`` numbers, whatever the size of the corpus, and gives runs of equal sequences.

Documents come in only to be numbered: pieces of a length count up over blocks (in two levels, so no
task holds all blocks of a common length), and the piece's number says which run, which sequence and which place
there it takes. Texts are tokenised once, on reading; blocks hold their compressed ids.

A document longer than a sequence is cut into full pieces, its first piece takes what is over; others aren't cut.

Defined cases: a null or empty text is one end token; repeated rows are packed as often as they occur; null ids stay null;
long texts are tokenised whole; ties (pieces of equal length) go in the order of the table; an empty table gives no piece;
other input columns aren't part of the result and may have any name.
"""

from __future__ import annotations

import base64
import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlink.llm._blocks import BLOB, BLOCK, BLOCK_BYTES, in_blocks, unpack
from tierlink.llm._bytes import binary_rows, column_bytes, releasing
from tierlink.session import materialize

END_ID = 2
WINDOW_TOKENS = 1024
VOCABULARY = "byte_bpe_50k.json"
ROUNDS = 2
BATCH = 128  # columns that enter the active set at once
CLOSE = 0.002  # a fit ends when this share of the pieces is off; the next round fits what is left
STEPS = 300  # batches of one fit at most; a fit cut short leaves more to the residual, nothing is lost
SUPER = 1024  # blocks whose counts are run up together


class Encoder:
    """Packed little-endian ids of texts by a tokenizer file.

    A byte-level merge table whose ids are its ranks is run by a faster library with the same result (a test
    holds both against each other); any other file is run as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        state = json.loads(self._slow.to_str())
        self._fast = self._merge_table(state)

    @staticmethod
    def _merge_table(state: dict):
        import tiktoken

        pre, model = state.get("pre_tokenizer") or {}, state["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not state.get("normalizer")
        options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        if not plain or model["type"] != "BPE" or any(model.get(o) for o in options) or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in state["added_tokens"]):
            return None
        # printable Latin-1 stands for its byte, the other bytes for the code points from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        code = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"]: t["id"] for t in state["added_tokens"]}
        ranks = {bytes(code[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"]["".join(m)] for m in merges]
        if len(ranks) != 256 + len(merges) or ids != sorted(ids) or any(len(t) != 1 for t, i in ranks.items() if i < ids[0]):
            return None
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        if self._fast is None:
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4")
        return self._fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def documents(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text (null: empty) with the end id."""
        end = np.array([END_ID], "<u4").tobytes()
        return pa.array([self.ids(t.as_py() or "").tobytes() + end for t in texts], pa.binary())


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder a process; ``vocabulary`` is a path or the name of an installed public tokenizer."""
    if vocabulary not in _encoders:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _encoders[vocabulary] = Encoder(str(path))
    return _encoders[vocabulary]


def patterns(present: np.ndarray, window: int) -> np.ndarray:
    """[pattern, 3] falling lengths (0: none) out of ``present`` that add up to ``window``."""
    there = np.zeros(window + 1, bool)
    there[present] = True
    found = [np.array([[window, 0, 0]])] if there[window] else []
    for a in np.flatnonzero(there)[::-1]:
        if a < window:
            b = np.arange(1, min(int(a), window - int(a)) + 1)
            c = window - a - b
            on = (c <= b) & there[b] & ((c == 0) | there[c])
            found.append(np.stack([np.full(on.sum(), a), b[on], c[on]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def least_squares(columns: np.ndarray, target: np.ndarray) -> np.ndarray:
    """x >= 0 of least ||A x - target||, A having a one for each length above 0 of a column; few are above 0."""
    n = len(target)
    x, active = np.zeros(len(columns)), np.zeros(len(columns), bool)

    def dense(which: np.ndarray) -> np.ndarray:
        a = np.zeros((n, len(which)))
        for j in range(columns.shape[1]):
            np.add.at(a, (columns[which, j], np.arange(len(which))), 1.0)
        a[0] = 0
        return a

    batch, best, kept = BATCH, np.inf, x
    for _ in range(STEPS):
        used = np.flatnonzero(x)
        rest = target - dense(used) @ x[used]
        rest[0] = 0
        error = float(rest @ rest)
        if error < best * (1 - 1e-6):
            best, kept = error, x.copy()
        elif batch == 1:
            break
        else:  # columns that came together were in each other's way
            batch //= 2
        if np.abs(rest).sum() <= CLOSE * target.sum():
            break
        slope = rest[columns].sum(1)
        slope[active] = 0
        enter = np.argsort(-slope, kind="stable")[:batch]
        enter = enter[slope[enter] > 0]
        if not len(enter):
            break
        active[enter] = True
        while (which := np.flatnonzero(active)).size:
            a = dense(which)
            z = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(which)), a.T @ target)
            active[which[z <= 0]] = False
            if (z > 0).all():
                break
        x[:] = 0
        if which.size:
            x[which] = z
    return kept


def fitted(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and whole repeats, fitted to the histogram ``left``, which loses what they use."""
    columns = patterns(np.flatnonzero(left), window)
    if not len(columns):
        return []
    x = least_squares(columns, left.astype(np.float64))
    count = np.floor(x + 1e-6).astype(np.int64)
    kept = []
    for i in np.argsort(-count, kind="stable"):  # the most frequent first; a pattern gets no more than there is
        need = Counter(int(v) for v in columns[i] if v)
        c = min([int(count[i]), *(int(left[v]) // k for v, k in need.items())])
        if c > 0:
            for v, k in need.items():
                left[v] -= c * k
            kept.append((tuple(int(v) for v in columns[i] if v), c))
    return kept


def best_fit(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """The histogram packed by best fit, longest first; equal sequences are one group."""
    open_: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # space -> contents -> sequences
    for v in range(window, 0, -1):
        n = int(left[v])
        while n:
            space = min((s for s, groups in open_.items() if s >= v and groups), default=None)
            if space is None:
                each = window // v
                for per, how in ((each, n // each), (n % each, 1)):
                    if per and how:
                        open_[window - per * v][(v,) * per] += how
                break
            held, k = next(iter(open_[space].items()))
            took = min(n, k)
            open_[space][held] -= took
            if not open_[space][held]:
                del open_[space][held]
            open_[space - v][(*held, v)] += took
            n -= took
    return [(held, k) for groups in open_.values() for held, k in groups.items()]


def plan_sequences(histogram: dict[int, int], window: int = WINDOW_TOKENS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences for pieces of these lengths and counts; every piece has a place."""
    left = np.zeros(window + 1, np.int64)
    for v, n in histogram.items():
        left[v] += n
    full = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    kept: list[tuple[tuple[int, ...], int]] = []
    for _ in range(ROUNDS):
        kept += fitted(left, window)
    return full + kept + best_fit(left, window)


class Slots:
    """Where the pieces of each length go, by their number: runs of equal sequences."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], window: int):
        runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length -> (first number, first sequence, place)
        next_of: dict[int, int] = defaultdict(int)
        sequence = 0
        for lengths, repeats in plan:
            at = 0
            for v in lengths:
                runs[v].append((next_of[v], sequence, at))
                next_of[v] += repeats
                at += v
            sequence += repeats
        self.sequences = sequence
        self._of = np.zeros(window + 2, np.int64)
        rows = [r for v in range(window + 1) for r in runs.get(v, [])]
        self._of[1:] = np.cumsum([len(runs.get(v, [])) for v in range(window + 1)])
        self._first, self._sequence, self._place = (np.array([r[k] for r in rows], np.int64) for k in range(3))

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place) of pieces."""
        run = np.empty(len(length), np.int64)
        for v in np.unique(length):
            on = length == v
            i, j = self._of[v], self._of[v + 1]
            run[on] = i + np.searchsorted(self._first[i:j], number[on], "right") - 1
        return self._sequence[run] + number - self._first[run], self._place[run]


def piece_bounds(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, piece, start, length) of all pieces of documents of these sizes (1 at least)."""
    over = sizes % window
    count = sizes // window + (over > 0)
    doc = np.repeat(np.arange(len(sizes)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    head = np.where(over > 0, over, window)[doc]
    start = np.where(piece > 0, head + (piece - 1) * window, 0)
    return doc, piece, start, np.where(piece > 0, window, head)


def pack_patterns(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW_TOKENS, vocabulary: str = VOCABULARY, block_bytes: int = 2 * BLOCK_BYTES) -> DataFrame:
    """One row a piece: id, piece, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    wanted = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), encoder(vocabulary).documents(batch.column(1))], names=["__id", "__ids"])

    blocks = materialize(in_blocks(wanted, "__text", block_bytes, encode, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sizes = np.diff(column_bytes(unpack(blob.as_buffer()).column("__ids"))[1]) // 4
                length, n = np.unique(piece_bounds(sizes, window)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(length), block)), pa.array(length.astype(np.int32)), pa.array(n.astype(np.int64))], names=["block", "length", "n"])

    sizes = materialize(blocks.mapInArrow(measure, "block long, length int, n long"))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``window`` rows at most
    slots = Slots(plan_sequences(histogram, window), window)

    near = sizes.withColumn("super", F.expr(f"block div {SUPER}"))
    whole = near.groupBy("length", "super").agg(F.sum("n").alias("n"))
    whole = whole.select("length", "super", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    run = Window.partitionBy("length", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = near.withColumn("own", F.coalesce(F.sum("n").over(run), F.lit(0))).join(whole, ["length", "super"])
    first = first.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", (F.col("base") + F.col("own")).alias("number")))).alias("firsts"))

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

    def place(key, t: pa.Table, where: pa.Table) -> pa.Table:
        t = unpack(t.column(BLOB)[0].as_py())
        ids, off = column_bytes(t.column("__ids"))
        tokens, off = np.frombuffer(ids.tobytes(), "<u4"), off // 4
        doc, piece, start, length = piece_bounds(np.diff(off), window)
        base = np.zeros(window + 1, np.int64)
        for r in where.column("firsts")[0].as_py():
            base[r["length"]] = r["number"]
        order = np.argsort(length, kind="stable")
        ranked = length[order]
        number = np.empty(len(length), np.int64)
        number[order] = np.arange(len(length)) - np.searchsorted(ranked, ranked)
        sequence, offset = slots.of(length, number + base[length])
        found = {"piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length), "doc_tokens": pa.array(np.diff(off)[doc]), "sequence_id": pa.array(sequence), "offset": pa.array(offset)}
        return pa.table({id_col: t.column("__id").take(pa.array(doc))} | found | {"ids": binary_rows(tokens, np.append(off[doc] + start, off[-1]))})

    return blocks.groupBy(BLOCK).cogroup(first.groupBy("block")).applyInArrow(releasing(place), schema)


def op11_query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``pack_patterns`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_patterns(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
