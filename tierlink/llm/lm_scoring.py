"""Hierarchical Pitman-Yor language model over words, trained and applied in blocks and buckets.

Each word follows its predecessor in a context restaurant; all context restaurants share one parent,
the unigram restaurant, whose base is uniform over the V known words and one unknown. A context
restaurant's customers of one dish (a word pair) sit at tables by the Chinese restaurant process; a
pair's tables are customers of the parent, whose dishes (words) sit at tables of the root.

Seatings are sampled by Gibbs, a dish at a time: given all other dishes, the number of tables t of a
dish of c customers has probability in proportion to a^t S(c, t), with a = (theta + d t_u) P(w) the
weight of a new table and S the Stirling numbers of discount d. Every dish is drawn from it, exactly
up to ``EXACT`` customers, beyond by the normal law at the saddle point of the generating function.
The draws of a dish are a function of its name, c, a and the sweep, so each block that holds a pair
finds the same tables without being told. ``BURN_IN`` sweeps start from expected totals; their sampled
totals of contexts, words and root are exchanged and enter the weights of the ``SWEEPS`` sweeps that
are averaged. Within each of these two rounds a dish sees the others through the totals of the round
before, so dishes are drawn apart and a frequent context is spread over all buckets. The predictive
probability

    P(w | u) = (c_uw - d t_uw + (theta + d t_u) P(w)) / (theta + c_u)

is affine in the seating, so the averages of t over the samples give the averaged predictive
probability (but for the covariance of t_u and P(w)). Sums of tables are exact integers, so the
probabilities after any context sum to one.

Exchanges between blocks and buckets (see ``_blocks``), all in packed arrays: counts of words
(64-bit names) and pairs (48-bit names; a clash only blurs one estimate), and twice the sums of
tables by context and by word. Counts cover all training documents. Sorted names travel as
compressed differences.

Defined cases: null and empty texts are one end token; repeated rows count and score as often as
they occur; with no training document the model is the uniform base over the unknown word; an empty
table gives an empty result; long texts are scored whole; equal texts get equal scores (no ties are
broken). The result holds the id columns only, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.llm._blocks import BLOB, BLOCK, BUCKET, buckets_for, in_blocks, unpack
from tierlink.llm._bytes import LOWER, U64, Fingerprints, column_bytes, mix, releasing, words
from tierlink.session import materialize

END = U64(0x9D39247E33776D41)  # name of the end token; also the context of a first word
DISCOUNT, THETA = 0.75, 1.0
ROOT_DISCOUNT, ROOT_THETA = 0.5, 1.0
BURN_IN, SWEEPS = 2, 4
EXACT = 256  # customers up to which table numbers are drawn from their exact distribution
BANDS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, EXACT)  # customers that are drawn together
DRAWN_AT_ONCE = 1 << 20
LM_BLOCK_BYTES = 2 << 20  # names, pairs and counts of a block take some 60 times its text in a worker
SHORT = 48  # bits of a name where a clash only blurs an estimate


def squeeze(a: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def expand(raw: bytes, n: int, kind) -> np.ndarray:
    if not n:
        return np.zeros(0, kind)
    size = n * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw, decompressed_size=size, codec="zstd"), kind)


def small_ints(a: np.ndarray) -> np.ndarray:
    """As bytes where they fit, else as 32- or 64-bit integers; the receiver tells by the size."""
    most = a.max() if len(a) else 0
    return a.astype(np.uint8 if most < 256 else np.uint32 if most < 1 << 32 else np.uint64)


def pack_ints(a: np.ndarray) -> bytes:
    b = small_ints(a)
    return bytes([b.itemsize]) + squeeze(b)


def unpack_ints(raw: bytes, n: int) -> np.ndarray:
    return expand(raw[1:], n, {1: np.uint8, 4: np.uint32, 8: np.uint64}[raw[0]]).astype(np.int64)


def pack_sorted(names: np.ndarray, bits: int = 64) -> bytes:
    """Ascending names, their top ``bits``, as compressed byte planes of the differences."""
    v = names >> U64(64 - bits)
    step = np.diff(v, prepend=U64(0))
    return squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T))


def unpack_sorted(raw: bytes, n: int) -> np.ndarray:
    planes = expand(raw, 8 * n, np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(U64), dtype=U64)


class Distinct:
    """Distinct names of a block in the order they are sent: by bucket (a range of names), then by name."""

    def __init__(self, names: np.ndarray, n_buckets: int):
        self.names, self.inverse = np.unique(names, return_inverse=True)
        bucket = ((self.names >> U64(32)) * U64(n_buckets)) >> U64(32)
        self.bounds = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))

    def slices(self):
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            yield b, slice(int(self.bounds[b]), int(self.bounds[b + 1]))


class Tokens:
    """Tokens of a block's documents: word names, then the end, and their contexts."""

    def __init__(self, rows: pa.Table, text: str, held: str, n_buckets: int):
        buf, off = column_bytes(rows.column(text))
        low = LOWER[buf]
        start, end, doc = words(low, off)
        n = len(off) - 1
        count = np.bincount(doc, minlength=n) if n else np.zeros(0, np.int64)
        self.end_at = np.cumsum(count + 1) - 1
        total = int(self.end_at[-1]) + 1 if n else 0
        self.names = np.full(total, END)
        is_word = np.ones(total, bool)
        is_word[self.end_at] = False
        self.names[is_word] = Fingerprints(low).of(start, end)
        self.doc = np.repeat(np.arange(n), count + 1)
        context = np.empty(total, U64)
        context[1:] = self.names[:-1]
        if total:
            context[np.concatenate([[0], self.end_at[:-1] + 1])] = END
        self.train = ~np.array(rows.column(held).to_pylist(), bool)[self.doc] if n else np.zeros(0, bool)
        self.words = Distinct(self.names, n_buckets)
        self.word = self.words.inverse
        # a context is the word before; the end's name, if the block has any token, is among the words
        self.context = np.empty(total, np.int64)
        self.context[1:] = self.word[:-1]
        if total:
            self.context[np.concatenate([[0], self.end_at[:-1] + 1])] = self.word[self.end_at[0]]
        self._context_names, self._n_buckets = context, n_buckets
        self.n_docs, self.n_tokens = n, count + 1

    @cached_property
    def pairs(self) -> Distinct:
        return Distinct(mix(self._context_names * U64(0x9E3779B97F4A7C15) + self.names), self._n_buckets)

    @property
    def pair(self) -> np.ndarray:
        return self.pairs.inverse

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word[self.train], minlength=len(self.words.names))

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pair[self.train], minlength=len(self.pairs.names))

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """(context, word) of each distinct pair."""
        c, w = np.zeros(len(self.pairs.names), np.int64), np.zeros(len(self.pairs.names), np.int64)
        c[self.pair], w[self.pair] = self.context, self.word
        return c, w


@cache
def log_stirling(d: float) -> np.ndarray:
    """[customers, tables] logarithms of the Stirling numbers S of discount d, up to ``EXACT`` customers."""
    t = np.arange(EXACT + 1)
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(2, EXACT + 1):
        stay = np.log(np.maximum(c - 1 - d * t, 1e-300)) + out[c - 1]
        out[c, 1:] = np.logaddexp(stay[1:], out[c - 1, :-1])
        out[c, c + 1 :] = -np.inf
    return out


def large_tables(c: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of p(t) ~ a^t S(c, t) by the saddle point z of exp(a (1 - (1 - z)^d) / d)."""
    lo, hi = np.minimum(0, np.log(a / c) / (1 - d)) - 1, np.full(len(c), -1e-12)  # log(1 - z)
    for _ in range(60):
        mid = (lo + hi) / 2
        more = np.log(a) + np.log(-np.expm1(mid)) + (d - 1) * mid > np.log(c)
        lo, hi = np.where(more, mid, lo), np.where(more, hi, mid)
    tables, z = -a * np.expm1(d * lo) / d, -np.expm1(lo)
    return 1 + tables, np.sqrt(np.maximum(tables - a * z * np.exp(d * lo) / (1 - d * z), 0))


def uniform(names: np.ndarray, k: int) -> np.ndarray:
    """The k-th random number in (0, 1) of each name."""
    return ((mix(names + U64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gibbs_tables(c: np.ndarray, a: np.ndarray, d: float, names: np.ndarray, sweeps: range) -> np.ndarray:
    """Sum over ``sweeps`` of the sampled numbers of tables of each dish.

    ``c``: customers of the dish, ``a``: weight of a new table, (theta + d t_u) P(w).
    """
    out = np.minimum(c, 1) * len(sweeps)
    for least, most in zip((2, *(b + 1 for b in BANDS[:-1])), BANDS, strict=True):
        band = np.flatnonzero((c >= least) & (c <= most))
        t = np.arange(1, most + 1)
        step = max(1, DRAWN_AT_ONCE // most)
        for i in range(0, len(band), step):
            own = band[i : i + step]
            p = log_stirling(d)[c[own], 1 : most + 1] + np.log(a[own])[:, None] * t
            p = np.cumsum(np.exp(p - p.max(1, keepdims=True)), axis=1)
            for k in sweeps:
                out[own] += (p < (uniform(names[own], 2 * k) * p[:, -1])[:, None]).sum(1)
    own = np.flatnonzero(c > EXACT)
    if len(own):
        mean, deviation = large_tables(c[own].astype(float), a[own], d)
        for k in sweeps:
            normal = np.sqrt(-2 * np.log(uniform(names[own], 2 * k))) * np.cos(2 * np.pi * uniform(names[own], 2 * k + 1))
            out[own] += np.clip(np.rint(mean + deviation * normal), 1, c[own]).astype(np.int64) - 1
    return out


def merged(names: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct names, index of each entry's name among them, sums of the values by name) over several blocks."""
    distinct, inverse = np.unique(np.concatenate(names), return_inverse=True)
    return distinct, inverse, np.bincount(inverse, np.concatenate(values)).astype(np.int64)


SENT = f"{BUCKET} int, {BLOCK} long, kind string, n int, names binary, a binary, b binary, root double"
ANSWER = f"{BLOCK} long, {BUCKET} int, kind string, a binary, b binary, c binary, total long, other long"


def sent_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.table({c: pa.array(v, k) for c, v, k in zip((BUCKET, BLOCK, "kind", "n", "names", "a", "b", "root"), columns, kinds, strict=True)})


def answer_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
    return pa.table({c: pa.array(v, k) for c, v, k in zip((BLOCK, BUCKET, "kind", "a", "b", "c", "total", "other"), columns, kinds, strict=True)})


def by_kind(replies: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {"words": [], "pairs": [], "first": [], "last": []}
    for x in replies.to_pylist():
        out[x["kind"]].append(x)
    return out


class Model:
    """What a block knows of the model: counts, and the sums of tables after a round of ``sweeps`` sweeps."""

    def __init__(self, tokens: Tokens, replies: dict[str, list[dict]], train_tokens: int, vocabulary: int):
        self.tokens, self.train_tokens, self.vocabulary = tokens, train_tokens, vocabulary
        self.count = self._by_word(replies["words"], "a")
        self.customers, self.owner = self._pairs(replies["pairs"])
        self.context, self.word = tokens.ends()

    def _by_word(self, answers: list[dict], column: str) -> np.ndarray:
        bounds = self.tokens.words.bounds
        out = np.zeros(len(self.tokens.words.names), np.int64)
        for x in answers:
            i, j = int(bounds[x[BUCKET]]), int(bounds[x[BUCKET] + 1])
            out[i:j] = unpack_ints(x[column], j - i)
        return out

    def _pairs(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """(customers of each distinct pair, whether this block speaks for it)."""
        total = self.tokens.pair_counts()
        owner = np.zeros(len(total), bool)
        bounds = self.tokens.pairs.bounds
        for x in answers:
            i, j = int(bounds[x[BUCKET]]), int(bounds[x[BUCKET] + 1])
            flags = np.unpackbits(np.frombuffer(x["a"], np.uint8), count=2 * (j - i)).reshape(-1, 2).astype(bool)
            on = np.flatnonzero(flags[:, 0]) + i
            total[on] = unpack_ints(x["b"], len(on))
            owner[i:j] = flags[:, 1]
        return total, owner

    def expected(self) -> tuple[np.ndarray, np.ndarray]:
        """(tables of each context, probability of each word by the parent) that the first sweeps start from."""
        return np.maximum(1, self.count) ** 0.85, np.maximum(self.count, 0.5) / max(1, self.train_tokens)

    def sampled(self, answers: list[dict], sweeps: int) -> tuple[np.ndarray, np.ndarray]:
        """The same from the sums of tables after a round."""
        by_context, by_word, root_tables = (self._by_word(answers, c) / sweeps for c in "abc")
        customers, tables = (answers[0][c] / sweeps if answers else 0.0 for c in ("all_customers", "all_tables"))
        base = 1 / (self.vocabulary + 1)
        parent = (by_word - ROOT_DISCOUNT * root_tables + (ROOT_THETA + ROOT_DISCOUNT * tables) * base) / (ROOT_THETA + customers)
        return by_context, parent

    def tables(self, tables_of: np.ndarray, parent: np.ndarray, sweeps: range, which: np.ndarray) -> np.ndarray:
        """Sums over ``sweeps`` of the tables of the pairs ``which``, given the totals."""
        weight = (THETA + DISCOUNT * tables_of[self.context[which]]) * parent[self.word[which]]
        return gibbs_tables(self.customers[which], weight, DISCOUNT, self.tokens.pairs.names[which], sweeps)


def lm_score(docs: DataFrame, held_out: str, id_cols: list[str], text: str = "text", block_bytes: int = LM_BLOCK_BYTES) -> DataFrame:
    """(id_cols, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    ``held_out``: boolean column of documents that aren't learned. Scores are log10 probabilities;
    ``base_score`` is the add-one unigram model's.
    """
    wanted = docs.select(*id_cols, F.coalesce(held_out, F.lit(False)).alias("__held"), F.col(text).alias("__text"))
    n_buckets = buckets_for(wanted, "__text", block_bytes)
    packed = in_blocks(wanted, "__text", block_bytes)
    blocks = packed.groupBy(BLOCK)

    def opened(t: pa.Table) -> tuple[pa.Table, Tokens]:
        rows = unpack(t.column(BLOB)[0].as_py())
        return rows, Tokens(rows, "__text", "__held", n_buckets)

    # 1. counts of words and pairs
    def send_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                _, tokens = opened(one)
                block, words, pairs = one.column(BLOCK)[0].as_py(), tokens.word_counts(), tokens.pair_counts()
                sent = [(b, block, "words", r.stop - r.start, pack_sorted(tokens.words.names[r]), pack_ints(words[r]), b"", 0.0) for b, r in tokens.words.slices()]
                sent += [(b, block, "pairs", r.stop - r.start, pack_sorted(tokens.pairs.names[r], SHORT), pack_ints(pairs[r]), b"", 0.0) for b, r in tokens.pairs.slices()]
                yield from sent_table(sent).to_batches()

    def sum_counts(t: pa.Table) -> pa.Table:
        out = []
        for kind in ("words", "pairs"):
            r = [x for x in t.sort_by(BLOCK).to_pylist() if x["kind"] == kind]
            if not r:
                continue
            own = [unpack_ints(x["a"], x["n"]) for x in r]
            _, inverse, total = merged([unpack_sorted(x["names"], x["n"]) for x in r], own)
            cut = np.cumsum([0, *map(len, own)])
            known = (int(total.sum()), int((total > 0).sum()))
            if kind == "words":
                out += [(x[BLOCK], x[BUCKET], kind, pack_ints(total[inverse[i:j]]), b"", b"", *known) for x, i, j in zip(r, cut[:-1], cut[1:], strict=True)]
                continue
            first = np.zeros(len(total), np.int64)
            first[inverse[::-1]] = np.arange(len(inverse))[::-1]
            owner = np.zeros(len(inverse), bool)
            owner[first] = True
            told = total[inverse] != np.concatenate(own)  # a block knows the rest by itself
            for x, i, j in zip(r, cut[:-1], cut[1:], strict=True):
                flags = np.packbits(np.stack([told[i:j], owner[i:j]], 1)).tobytes()
                out.append((x[BLOCK], x[BUCKET], kind, flags, pack_ints(total[inverse[i:j][told[i:j]]]), b"", 0, 0))
        return answer_table(out)

    counts = materialize(packed.mapInArrow(releasing(send_counts), SENT).groupBy(BUCKET).applyInArrow(releasing(sum_counts), ANSWER))
    sums = counts.where("kind = 'words'").groupBy(BUCKET).agg(F.max("total").alias("n"), F.max("other").alias("v")).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    train_tokens, vocabulary = int(sums["n"] or 0), int(sums["v"] or 0)
    counts = counts.drop("total", "other")

    def answered(*rounds: DataFrame) -> DataFrame:
        """All replies to blocks; those of a round with its totals of the root restaurant."""
        out = counts.withColumns({"all_customers": F.lit(0).cast("long"), "all_tables": F.lit(0).cast("long")})
        for x in rounds:
            totals = x.groupBy(BUCKET).agg(F.max("total").alias("s"), F.max("other").alias("t")).agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_customers"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_tables"))
            out = out.unionByName(x.drop("total", "other").crossJoin(F.broadcast(totals)))  # one row
        return out

    # 2. rounds of sweeps, and their sums of tables by context and by word
    def sampled(kind: str, before: DataFrame, burnt: bool) -> DataFrame:
        sweeps = range(BURN_IN, BURN_IN + SWEEPS) if burnt else range(BURN_IN)

        def send_tables(key, t: pa.Table, replies: pa.Table) -> pa.Table:
            if not t.num_rows:
                return sent_table([])
            _, tokens = opened(t)
            found = by_kind(replies)
            model = Model(tokens, found, train_tokens, vocabulary)
            mine = np.flatnonzero(model.owner & (model.customers > 0))
            tables = model.tables(*(model.sampled(found["first"], BURN_IN) if burnt else model.expected()), sweeps, mine)
            n = len(tokens.words.names)
            by_context, by_word = (np.bincount(x[mine], tables, n).astype(np.int64) for x in (model.context, model.word))
            root = found["first"][0]["all_tables"] / BURN_IN if burnt else float(vocabulary)
            return sent_table([(b, key[0].as_py(), kind, r.stop - r.start, pack_sorted(tokens.words.names[r], SHORT), pack_ints(by_context[r]), pack_ints(by_word[r]), root) for b, r in tokens.words.slices()])

        def sum_tables(t: pa.Table) -> pa.Table:
            r = t.sort_by(BLOCK).to_pylist()
            names = [unpack_sorted(x["names"], x["n"]) for x in r]
            cut = np.cumsum([0, *map(len, names)])
            _, _, by_context = merged(names, [unpack_ints(x["a"], x["n"]) for x in r])
            distinct, inverse, by_word = merged(names, [unpack_ints(x["b"], x["n"]) for x in r])
            # the root seats the mean number of customers; at first its tables are expected to be one a word
            weight = np.full(len(by_word), (ROOT_THETA + ROOT_DISCOUNT * r[0]["root"]) / (vocabulary + 1))
            root = gibbs_tables(np.rint(by_word / len(sweeps)).astype(np.int64), weight, ROOT_DISCOUNT, distinct << U64(64 - SHORT), sweeps)
            whole = (int(by_word.sum()), int(root.sum()))
            return answer_table([(x[BLOCK], x[BUCKET], kind, *(pack_ints(v[inverse[i:j]]) for v in (by_context, by_word, root)), *whole) for x, i, j in zip(r, cut[:-1], cut[1:], strict=True)])

        return blocks.cogroup(before.groupBy(BLOCK)).applyInArrow(releasing(send_tables), SENT).groupBy(BUCKET).applyInArrow(releasing(sum_tables), ANSWER)

    first = sampled("first", answered(), burnt=False)
    last = sampled("last", answered(first), burnt=True)

    # 3. scores
    def rate(key, t: pa.Table, replies: pa.Table) -> pa.Table:
        rows, tokens = opened(t)
        found = by_kind(replies)
        model = Model(tokens, found, train_tokens, vocabulary)
        u, w, pair = tokens.context, tokens.word, tokens.pair
        tables = model.tables(*model.sampled(found["first"], BURN_IN), range(BURN_IN, BURN_IN + SWEEPS), np.arange(len(model.customers))) / SWEEPS
        seated, parent = model.sampled(found["last"], SWEEPS)
        count = model.count
        customers = count[u].astype(float)  # a word is a context as often as it occurs, the end included
        p = (model.customers[pair] - DISCOUNT * tables[pair] + (THETA + DISCOUNT * seated[u]) * parent[w]) / (THETA + customers)
        score = np.bincount(tokens.doc, np.log10(np.maximum(p, 1e-300)), tokens.n_docs)
        plain = np.log10((count[w] + 1.0) / (train_tokens + 1.0 * (vocabulary + 1)))
        out = rows.drop_columns(["__text", "__held"]).append_column("held_out", rows.column("__held"))
        known = np.bincount(tokens.doc, count[w] > 0, tokens.n_docs).astype(np.int64)
        for name, value, k in (("n_tokens", tokens.n_tokens, pa.int64()), ("n_known", known, pa.int64()), ("train_tokens", np.full(tokens.n_docs, train_tokens), pa.int64()), ("base_score", np.bincount(tokens.doc, plain, tokens.n_docs), pa.float64()), ("score", score, pa.float64())):
            out = out.append_column(name, pa.array(value, k))
        return out

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return blocks.cogroup(answered(first, last).groupBy(BLOCK)).applyInArrow(releasing(rate), f"{fields}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_query(spark, sf_dir: str) -> DataFrame:
    """Score of every document, learning from those outside the held-out seventh."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_score(docs.withColumn("held", F.coalesce(held, F.lit(False))), "held", ["doc_id"])
