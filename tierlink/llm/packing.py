"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of its documents' tokens with a target weight: by default its share of all
tokens, else what ``weights`` says. In every round each queue's deficit grows by its quantum (in
proportion to its weight) and whole tokens are served while the deficit allows it, the nearest to
half a token; what is left is carried on to the next window. After v rounds queue s has sent
c_s(v) = min(n_s, floor(v * weight_s + 1/2)) tokens, so the deficits at any window follow from the
queues' sizes alone: the round-robin is carried across windows and partitions without running it
in sequence. A window holds the tokens that the queues send from one multiple of ``window`` tokens
in all to the next; where several queues step in the same round, the first in order goes first. So
sequences are gapless and disjoint for any sizes, however rare a source is, and every window holds
each live source's target to within a token or two (six at most in tests of up to 1000 sources). A queue that has run dry leaves its share to the
others in proportion to their weights; with the default weights all run dry together.

Queues are numbered; number modulo ``GROUPS`` names a group. Groups take turns as queues do, and
so do the members within a group, so any number of sources needs only the groups' totals (bounded)
and the members of one group at a time. Up to ``GROUPS`` sources have groups of their own.

Documents are cut where a window's quota ends; every token lies in exactly one piece. All windows
are full but the last, which is split into sequences of powers of two, so nothing is padded.

Token counts of (block, source) are summed per source over blocks and then within a block, so a
source with a third of all rows is spread over all blocks. A block's pieces are found from the
windows it touches: where a source's tokens lie further apart than windows, from token to token.
Texts are tokenised once, on reading; blocks hold their compressed ids.

Defined cases: a null or empty text is one end token; a null source is a queue of its own; repeated
rows are packed as often as they occur; long texts are tokenised whole, word by word; an empty table
gives no piece; ties (queues that step together) go in order of the queues' numbers. Other input
columns aren't part of the result and may have any name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierlink.llm._blocks import BLOB, BLOCK, BLOCK_BYTES, in_blocks, unpack
from tierlink.llm._bytes import binary_rows, column_bytes, releasing, row_slices
from tierlink.session import materialize

END_ID = 1
VOCABULARY = "word_bpe_49k.json"
GROUPS = 1024
GOLDEN = 0.6180339887498949
AT_ONCE = 1 << 18  # (window, queue) counts that are worked on at a time

#: Chunks of these characters are split and lower-cased here just as the tokenizer does it (tests hold both
#: against each other); others, and such with an apostrophe or ``<``, go through the tokenizer itself.
PLAIN = r"^[!-&(-;=-~\x{00A1}-\x{012F}\x{0131}-\x{024F}]+$"
PIECE = regex.compile(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n")


class Memo:
    """A bounded memo of keys and their packed ids in two Arrow arrays, some 20 bytes an entry."""

    MOST = 1 << 19

    def __init__(self, make):
        self._make = make  # missing keys -> their packed ids
        self._keys, self._ids = pa.array([], pa.binary()), pa.array([], pa.binary())

    def of(self, keys: pa.Array) -> pa.Array:
        """Packed ids of distinct ``keys``."""
        at = pc.index_in(keys, value_set=self._keys)
        missing = keys.filter(at.is_null())
        if len(missing):
            at = at.to_numpy(zero_copy_only=False)
            new = np.isnan(at)
            place = np.where(new, 0, at).astype(np.int64)
            place[new] = len(self._keys) + np.arange(len(missing))
            self._keys = pa.concat_arrays([self._keys, missing])
            self._ids = pa.concat_arrays([self._ids, self._make(missing)])
            at = pa.array(place)
        found = self._ids.take(at)
        if len(self._keys) > self.MOST:  # what the last text held stays
            self._keys, self._ids = keys, found
        return found


def packed_ids(lists) -> pa.Array:
    return pa.array([np.array(x, "<u4").tobytes() for x in lists], pa.binary())


class WordCache:
    """Packed little-endian ids of texts.

    If the tokenizer encodes white-space-delimited chunks independently, they are encoded once
    each; chunks are put together of pieces (letters, a digit, other signs), which are encoded in
    one call. Both memos are bounded. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        state = json.loads(self._tokenizer.to_str())
        splits = (state.get("pre_tokenizer") or {}).get("pretokenizers", [])
        byte_level = [p.get("type") for p in splits] == ["Split", "ByteLevel"] and "[^\\s\\p{L}\\p{N}]+" in json.dumps(splits[0]).replace("\\\\", "\\") and not splits[1].get("add_prefix_space")
        lower = [n.get("type") for n in (state.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        self.by_words = byte_level and lower and splits[0].get("behavior") == "Removed" and bool(state["model"].get("end_of_word_suffix"))
        if not self.by_words:
            return
        self._bare = Tokenizer(self._tokenizer.model)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the character that stands for each byte, read off two-byte characters
        self._bytes = {i: chr(i) for i in range(0x21, 0x7F)}
        for code in range(0xA1, 0x250):
            for byte, shown in zip(chr(code).encode(), level.pre_tokenize_str(chr(code))[0][0], strict=True):
                self._bytes[byte] = shown
        self._chunks, self._pieces = Memo(self._encode), Memo(self._encode_pieces)

    def _whole(self, texts: list[str]) -> pa.Array:
        return packed_ids(self._tokenizer.encode(t, add_special_tokens=False).ids for t in texts)

    def _encode(self, chunks: pa.Array) -> pa.Array:
        """Ids of new chunks without white space."""
        text = chunks.cast(pa.string())
        plain = pc.match_substring_regex(text, PLAIN)
        odd = text.filter(pc.invert(plain))
        out = self._plain(text.filter(plain))
        if not len(odd):
            return out
        plain = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(text), np.int64)
        place[plain] = np.arange(len(out))
        place[~plain] = len(out) + np.arange(len(odd))
        return pa.concat_arrays([out, self._whole(odd.to_pylist())]).take(pa.array(place))

    def _plain(self, chunks: pa.Array) -> pa.Array:
        if not len(chunks):
            return pa.array([], pa.binary())
        found = pa.array(PIECE.findall("\n".join(chunks.to_pylist()).lower() + "\n")).dictionary_encode()  # line ends are pieces of their own
        code, known = found.indices.to_numpy(), found.dictionary.cast(pa.binary())
        end = np.flatnonzero(code == pc.index(known, b"\n").as_py())
        joined, off = column_bytes(self._pieces.of(known).take(pa.array(code)))
        cut = off[np.concatenate([[0], end + 1])]
        return binary_rows(joined, cut)

    def _encode_pieces(self, pieces: pa.Array) -> pa.Array:
        texts = pieces.cast(pa.string()).to_pylist()
        shown = "\n".join("" if t == "\n" else t for t in texts).encode().decode("latin-1").translate(self._bytes).split("\n")
        got = self._bare.encode(shown, is_pretokenized=True, add_special_tokens=False)
        cuts = np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(texts) + 1))
        return binary_rows(np.array(got.ids, "<u4"), cuts)

    def documents(self, texts: pa.Array) -> pa.Array:
        """Packed ids of each text (null: empty) with the end id."""
        buf, off = column_bytes(texts)
        n = len(off) - 1
        if not n:
            return pa.array([], pa.binary())
        if not self.by_words:
            raw = buf.tobytes()
            return pa.array([bytes(x) + END for x in self._whole([raw[i:j].decode("utf-8", "replace") for i, j in zip(off[:-1], off[1:], strict=True)]).to_pylist()], pa.binary())
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(buf))])
        split = pc.ascii_split_whitespace(data.cast(pa.large_string()))
        words = split.flatten().cast(pa.binary()).dictionary_encode()
        ids, at = column_bytes(self._chunks.of(words.dictionary).take(words.indices))
        stop = at[split.offsets.to_numpy()] // 4
        out = np.empty(len(ids) // 4 + n, "<u4")  # an end id after each text
        ends = stop[1:] + np.arange(n)
        place = np.ones(len(out), bool)
        place[ends] = False
        out[place] = np.frombuffer(ids.tobytes(), "<u4")
        out[ends] = END_ID
        return binary_rows(out, np.concatenate([[0], ends + 1]))


END = np.array([END_ID], "<u4").tobytes()
_caches: dict[str, WordCache] = {}


def word_cache(vocabulary: str) -> WordCache:
    """One cache a process; ``vocabulary`` is a path or the name of an installed public tokenizer."""
    if vocabulary not in _caches:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _caches[vocabulary] = WordCache(str(path))
    return _caches[vocabulary]


class Turns:
    """Queues that send their tokens in turn: how many each has sent in the first x tokens, and the reverse.

    All figures are functions of the queues' sizes and weights alone, so every task gets the same.
    """

    def __init__(self, size: list[int], weight: list[float]):
        self.size, self.weight = np.array(size, np.int64), np.array(weight, np.float64)
        self.total = int(self.size.sum())
        self._first = (np.arange(len(size)) + 0.5) * GOLDEN % 1.0  # deficits that queues start with, evenly spread
        dry = self.size / self.weight
        order = np.argsort(dry, kind="stable")
        rate = self.weight.sum() - np.concatenate([[0.0], np.cumsum(self.weight[order])])
        self._round = np.concatenate([[0.0], dry[order]])  # rounds at which queues run dry, and tokens sent by then
        self._sent = np.concatenate([[0.0], np.cumsum(np.diff(self._round) * np.maximum(rate[:-1], 0))])

    def _count(self, v: np.ndarray) -> np.ndarray:
        """[round, queue] tokens sent in v rounds."""
        return np.minimum(self.size, np.floor(v[:, None] * self.weight + self._first).astype(np.int64))

    def _rounds(self, x: np.ndarray) -> np.ndarray:
        """Least v of which at least x tokens are sent."""
        slack = len(self.size) + 1.0
        lo = np.maximum(np.interp(x - slack, self._sent, self._round) * (1 - 1e-9) - 1e-12, 0)
        hi = np.interp(np.minimum(x + slack, self._sent[-1]), self._sent, self._round) * (1 + 1e-9) + 1 / self.weight.min()
        lo = np.where(self._count(lo).sum(1) >= x, 0.0, lo)
        while True:
            mid = (lo + hi) / 2
            mid = np.where((mid <= lo) | (mid >= hi), hi, mid)
            if (mid == hi).all():
                return hi
            enough = self._count(mid).sum(1) >= x
            lo, hi = np.where(enough, lo, mid), np.where(enough, mid, hi)

    def sent(self, x: np.ndarray) -> np.ndarray:
        """[x, queue] tokens of each queue among the first x (0 to the total) of all."""
        x = np.asarray(x, np.int64)
        if len(self.size) == 1:
            return x[:, None]
        out = np.zeros((len(x), len(self.size)), np.int64)
        some = np.flatnonzero(x > 0)
        if len(some):
            v = self._rounds(x[some].astype(np.float64))
            before = self._count(np.nextafter(v, 0.0))
            step = self._count(v) - before
            open_ = (x[some] - before.sum(1))[:, None] - (np.cumsum(step, 1) - step)
            out[some] = before + np.clip(open_, 0, step)
        return out

    def place(self, queue: int, q: np.ndarray) -> np.ndarray:
        """Place among all tokens of tokens q of a queue."""
        if len(self.size) == 1:
            return q
        w = self.weight[queue]

        def sent(v: np.ndarray) -> np.ndarray:
            return np.floor(v * w + self._first[queue]).astype(np.int64)

        v = np.maximum(q + 1 - self._first[queue], 0) / w
        while (short := sent(v) <= q).any():
            v = np.where(short, np.nextafter(v, np.inf), v)
        while (over := (sent(np.nextafter(v, 0.0)) > q) & (v > 0)).any():
            v = np.where(over, np.nextafter(v, 0.0), v)
        before = self._count(np.nextafter(v, 0.0))
        step = self._count(v) - before
        return before.sum(1) + step[:, :queue].sum(1) + (q - before[:, queue])


class Windows:
    """Tokens that queues sent before windows; a block's sources reach about the same windows, so these are kept."""

    MOST = 1 << 22

    def __init__(self, queues: Turns, window: int):
        self.queues, self.window = queues, window
        self._kept: dict[int, np.ndarray] = {}

    def sent(self, windows: np.ndarray) -> np.ndarray:
        if len(self._kept) * len(self.queues.size) > self.MOST:
            self._kept = {}
        new = [w for w in windows.tolist() if w not in self._kept]
        step = max(1, AT_ONCE // len(self.queues.size))
        for i in range(0, len(new), step):
            some = new[i : i + step]
            self._kept.update(zip(some, self.queues.sent(np.minimum(np.array(some) * self.window, self.queues.total)), strict=True))
        return np.stack([self._kept[w] for w in windows.tolist()])


def last_sequences(rest: int) -> list[int]:
    """Starts of the power-of-two sequences that the last, partial window is split into."""
    starts, at = [], 0
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            starts.append(at)
            at += 1 << bit
    return starts


def queue_pieces(before: Windows, group: int, members: Turns, member: int, begin: int, end: int) -> np.ndarray:
    """Rows (first token, sequence, offset, count) of a queue's tokens ``begin`` to ``end``, one a sequence they reach."""
    groups, window = before.queues, before.window

    def windows_of(q: np.ndarray) -> np.ndarray:
        return groups.place(group, members.place(member, q)) // window

    first, last = (int(w) for w in windows_of(np.array([begin, end - 1])))
    if last - first < end - begin:
        windows = np.arange(first, last + 1)
    else:  # fewer tokens than windows: from token to token
        step = max(1, AT_ONCE // len(groups.size))
        windows = np.unique(np.concatenate([windows_of(np.arange(i, min(i + step, end))) for i in range(begin, end, step)]))
    full, rest = divmod(groups.total, window)
    parts = []
    step = max(1, AT_ONCE // max(len(groups.size), len(members.size)))
    for i in range(0, len(windows), step):
        w = windows[i : i + step]
        a, b = before.sent(w), before.sent(w + 1)
        c, d = members.sent(a[:, group]), members.sent(b[:, group])
        from_, upto = np.maximum(c[:, member], begin), np.minimum(d[:, member], end)
        offset = (b - a)[:, :group].sum(1) + (d - c)[:, :member].sum(1) + from_ - c[:, member]
        on = upto > from_
        parts.append(np.stack([from_, w, offset, upto - from_], 1)[on])
    rows = np.concatenate(parts)
    if len(rows) and rows[-1, 1] == full:  # the last window
        at, _, offset, count = rows[-1].tolist()
        tail = last_sequences(rest)
        cuts = sorted({offset, offset + count, *(t for t in tail if offset < t < offset + count)})
        split = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            k = max(i for i, t in enumerate(tail) if t <= x)
            split.append((at + x - offset, full + k, x - tail[k], y - x))
        rows = np.concatenate([rows[:-1], np.array(split, np.int64)])
    return rows


def source_queues(sizes: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """(src, own, weight, grp): each source's tokens, target weight and group; numbered in two levels, so no task orders all."""
    own = sizes.groupBy("src").agg(F.sum("tokens").alias("own")).withColumn("part", F.pmod(F.xxhash64("src"), F.lit(1024)))
    if weights is None:
        own = own.withColumn("weight", F.col("own").cast("double"))
    else:
        wrong = {s: w for s, w in weights.items() if not w > 0}
        if wrong:
            raise ValueError(f"weights must be above 0: {wrong}")
        given = F.lit(1.0)
        for s, w in weights.items():
            given = F.when(F.col("src").eqNullSafe(F.lit(s)), F.lit(float(w))).otherwise(given)
        own = own.withColumn("weight", given)
    own = own.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("src")) - 1)
    own = materialize(own)
    counts = own.groupBy("part").agg(F.count("*").alias("k"))  # 1024 rows at most
    before = counts.withColumn("first", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(before), "part").select("src", "own", "weight", F.pmod(F.col("first") + F.col("n"), F.lit(GROUPS)).cast("int").alias("grp"))


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", window: int = 2048, vocabulary: str = VOCABULARY, block_bytes: int = 2 * BLOCK_BYTES, weights: dict[str | None, float] | None = None) -> DataFrame:
    """One row a piece: id, start, length, doc_tokens, sequence_id, offset, source, ids (little-endian unsigned 32-bit).

    ``weights``: target proportions by source, 1 for one that isn't named; None: the shares of all tokens.
    """
    wanted = docs.select(F.col(id_col).alias("__id"), F.col(source).cast("string").alias("__source"), F.col(text).alias("__text"))

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2)
        _, off = column_bytes(texts)
        parts = [word_cache(vocabulary).documents(texts.slice(i, j - i)) for i, j in row_slices(off, BLOCK_BYTES)]
        ids = pa.concat_arrays(parts) if parts else pa.array([], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["__id", "__source", "__ids"])

    blocks = materialize(in_blocks(wanted, "__text", block_bytes, encode, 2))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = unpack(blob.as_buffer())
                sums: dict[str | None, int] = {}
                for n, s in zip(np.diff(column_bytes(rows.column("__ids"))[1]) // 4, rows.column("__source").to_pylist(), strict=True):
                    sums[s] = sums.get(s, 0) + int(n)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(sums), pa.int64()), pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["block", "src", "tokens"])

    sizes = materialize(blocks.mapInArrow(measure, "block long, src string, tokens long"))
    queues = materialize(source_queues(sizes, weights))
    totals = queues.groupBy("grp").agg(F.sum("own").alias("own"), F.sum("weight").alias("weight")).orderBy("grp").collect()  # GROUPS rows at most
    groups = [[r[c] for r in totals] for c in ("grp", "own", "weight")]
    members = queues.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("src", "own", "weight"))).alias("members"))
    queue = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.withColumn("position", F.coalesce(F.sum("tokens").over(queue), F.lit(0)))
    at = at.join(queues.select(F.col("src").alias("own_src"), "grp"), F.col("src").eqNullSafe(F.col("own_src")))
    plan = at.groupBy("block", "grp").agg(F.collect_list(F.struct("src", "position")).alias("at")).join(members, "grp").select("block", "grp", "at", "members")

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary"

    def cut(key, t: pa.Table, where: pa.Table) -> pa.Table:
        t = unpack(t.column(BLOB)[0].as_py())
        ids, off = column_bytes(t.column("__ids"))
        tokens, off = np.frombuffer(ids.tobytes(), "<u4"), off // 4
        size = np.diff(off)
        named = t.column("__source").combine_chunks().dictionary_encode(null_encoding="encode")
        code, names = named.indices.to_numpy(), named.dictionary.to_pylist()
        before = Windows(Turns(groups[1], groups[2]), window)
        rows, starts, pieces, picked = [], [], [], []
        for r in where.to_pylist():
            group = groups[0].index(r["grp"])
            own = Turns([m["own"] for m in r["members"]], [m["weight"] for m in r["members"]])
            place = {m["src"]: i for i, m in enumerate(r["members"])}
            for x in r["at"]:
                mine = np.flatnonzero(code == names.index(x["src"]))  # its documents in order
                begin = x["position"] + np.concatenate([[0], np.cumsum(size[mine])])
                found = queue_pieces(before, group, own, place[x["src"]], int(begin[0]), int(begin[-1]))
                edges = np.unique(np.concatenate([found[:, 0], begin]))[:-1] if len(found) else np.zeros(0, np.int64)
                doc, piece = np.searchsorted(begin, edges, "right") - 1, np.searchsorted(found[:, 0], edges, "right") - 1
                upto = np.append(edges[1:], begin[-1])
                rows.append(mine[doc])
                starts.append(edges - begin[doc])
                pieces.append(np.stack([upto - edges, found[piece, 1], found[piece, 2] + edges - found[piece, 0]], 1))
        row, start, found = np.concatenate(rows), np.concatenate(starts), np.concatenate(pieces)
        order = np.lexsort((start, row))  # pieces in the order of the block's ids, so these are cut in place
        row, start, found = row[order], start[order], found[order]
        bounds = np.append(off[row] + start, off[-1])
        columns = {id_col: t.column("__id").take(pa.array(row)), "start": pa.array(start), "length": pa.array(found[:, 0]), "doc_tokens": pa.array(size[row]), "sequence_id": pa.array(found[:, 1]), "offset": pa.array(found[:, 2])}
        return pa.table(columns | {"source": t.column("__source").take(pa.array(row)), "ids": binary_rows(tokens, bounds)})

    return blocks.groupBy(BLOCK).cogroup(plan.groupBy("block")).applyInArrow(releasing(cut), schema)


def op4_query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``pack`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")
