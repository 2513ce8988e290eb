"""Counterfactual-regularised toxicity classifier.

Logistic regression on the presence of words and word beginnings. Candidate features of a bounded
sample of labelled rows are counted by class; the most telling are kept, besides those of all
identity terms. For every sampled text that names a group, copies of the text with the term swapped for each
other term of its set are made and counted like any text, and training adds ``penalty`` times the squared change of the
score: naming one group rather than another may not move a score, so neutral mentions stay low.

Learning uses at most ``per_class`` labelled rows of each class, chosen by the hash of the id; the
features counted and the sparse rows sent to the driver are bounded by that. Every whole text is
scored in one pass.

Defined cases: null and empty texts have no feature and get the model's base score; rows without a
label, or with a null one, null texts and ids aren't learned; rows of one id are learned once (least
label, then least text); repeated rows get equal scores; without labels, or with one class only, every
score is 0; an empty table gives an empty result; features of equal gain go by their hash; an input
column named as the score is replaced, others pass through; long texts are scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.llm._bytes import LOWER, U64, Fingerprints, column_bytes, mix, releasing, row_slices
from tierlink.llm._columns import without
from tierlink.llm._sample import least_hashes, sampled_texts

# Sets of identity terms that are swapped for each other.
IDENTITY_SETS = (
    ("women", "men", "girls", "boys", "female", "male", "transgender", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("american", "mexican", "chinese", "german", "french", "spanish", "indian", "turkish"),
    ("frauen", "männer"), ("juden", "christen", "muslime"),
    ("femmes", "hommes"), ("juifs", "chrétiens", "musulmans"),
    ("mujeres", "hombres"), ("judíos", "cristianos", "musulmanes"),
)
PREFIXES = (4, 5, 6, 7, 8)
CHANGE = pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32()))])
PER_CLASS = 3000
FEATURES = 512
SLICE_BYTES = 1 << 20
EDGE = np.ones(256, bool)  # bytes that words don't hold
EDGE[48:58] = EDGE[65:91] = EDGE[97:123] = EDGE[128:] = False


def word_features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature hash, document) of each word and of its beginnings; lower case, words end at any punctuation."""
    low = LOWER[buf]
    solid = np.concatenate([[False], ~EDGE[low], [False]])
    first = np.zeros(len(low) + 1, bool)
    first[off] = True  # a word ends with its document
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | first))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | first))
    doc = np.searchsorted(off, start, "right") - 1
    prints = Fingerprints(low)
    hashes, docs = [prints.of(start, end)], [doc]
    for k in PREFIXES:
        long = end - start > k
        hashes.append(mix(prints.of(start[long], start[long] + k) + U64(k)))
        docs.append(doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def features_of(word: str) -> np.ndarray:
    buf = np.frombuffer(word.encode(), np.uint8)
    return np.unique(word_features(buf, np.array([0, len(buf)]))[0])


class Known:
    """Membership of feature hashes in a sorted table."""

    def __init__(self, hashes: np.ndarray):
        self.table = np.unique(hashes)
        self.terms: dict[str, frozenset[int]] = {}
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[(self.table & U64((1 << 20) - 1)).astype(np.int64)] = True

    def term(self, term: str) -> frozenset[int]:
        """Indices of an identity term's features."""
        if term not in self.terms:
            self.terms[term] = frozenset(np.searchsorted(self.table, features_of(term)).tolist())
        return self.terms[term]

    def find(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, index of feature) pairs."""
        on = self.bitmap[(h & U64((1 << 20) - 1)).astype(np.int64)]
        h, doc = h[on], doc[on]
        at = np.searchsorted(self.table, h)
        at[at == len(self.table)] = 0
        ok = self.table[at] == h
        pairs = np.unique(doc[ok] * len(self.table) + at[ok])
        return np.divmod(pairs, len(self.table))


class Model:
    def __init__(self, known: Known, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = np.full(len(off) - 1, self.bias)
        doc, feature = self.known.find(*word_features(buf, off))
        np.add.at(z, doc, self.weights[feature])
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def swapped(low: bytes, have: np.ndarray, known: Known) -> list[tuple[list[int], list[int]]]:
    """(features lost, features gained) of each copy of a lower-case text with one identity term put in place of another."""
    own = set(have.tolist())
    out = []
    for terms in IDENTITY_SETS:
        for t in terms:
            if not own.issuperset(known.term(t)) or not term_pattern(t).search(low):
                continue
            for u in terms:
                if u != t:
                    copy = np.frombuffer(term_pattern(t).sub(u.encode(), low), np.uint8)
                    new = set(known.find(*word_features(copy, np.array([0, len(copy)])))[1].tolist())
                    out.append((sorted(own - new), sorted(new - own)))
    return out


@cache
def term_pattern(term: str) -> re.Pattern:
    inside = rb"[0-9A-Za-z\x80-\xff]"
    return re.compile(rb"(?<!" + inside + rb")" + re.escape(term.encode()) + rb"(?!" + inside + rb")")


def train(rows: list[np.ndarray], y: np.ndarray, changed: list[tuple[list[int], list[int]]], d: int, ridge: float, penalty: float, steps: int = 800) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression of d features, by Adam on all rows; ``changed``: features lost and gained by swapped copies."""
    n = len(rows)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    index = np.concatenate(rows) if n else np.zeros(0, np.int64)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    sign = np.concatenate([[-1.0] * len(a) + [1.0] * len(b) for a, b in changed]) if changed else np.zeros(0)
    swap_index = np.array([f for a, b in changed for f in (*a, *b)], np.int64)
    swap_owner = np.repeat(np.arange(len(changed)), [len(a) + len(b) for a, b in changed])
    w, m, v, bias = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1), 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[index], n) + w[d]
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        g = np.append(np.bincount(index, error[owner], d), error.sum())
        g[:d] += ridge * w[:d]
        if changed:
            delta = np.bincount(swap_owner, sign * w[swap_index], len(changed))
            g[:d] += 2 * penalty / len(changed) * np.bincount(swap_index, sign * delta[swap_owner], d)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w[:d], float(w[d])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, per_class: int = PER_CLASS, features: int = FEATURES, ridge: float = 1e-4, penalty: float = 1.0) -> Model | None:
    """Model of a bounded sample of labelled ``docs`` (label 0 or 1); None without both classes."""
    labelled = labels.select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("l")).where("l in (0, 1)")
    sample = sampled_texts(docs, id_col, text, least_hashes(labelled, per_class)).select(F.col("l").alias("y"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(0).to_numpy()
            buf, off = column_bytes(batch.column(1))
            for i, j in row_slices(off, SLICE_BYTES):
                h, d = word_features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                h, positive = h[first], y[i:j][d[first]]
                table, at = np.unique(h, return_inverse=True)
                total = np.bincount(at, minlength=len(table))
                toxic = np.bincount(at, positive, len(table))
                yield pa.RecordBatch.from_arrays([pa.array(table.view(np.int64)), pa.array(toxic.astype(np.int64)), pa.array((total - toxic).astype(np.int64))], names=["h", "p", "q"])

    by_class = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(by_class) < 2:
        return None
    n1, n0 = by_class[1], by_class[0]
    counts = sample.mapInArrow(count, "h long, p long, q long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).where("p + q >= 4")
    gain = F.abs(F.col("p") / n1 - F.col("q") / n0) / F.sqrt((F.col("p") + F.col("q") + 2) / (n1 + n0))
    best = counts.orderBy(gain.desc(), "h").limit(features).select("h").collect()
    identity = [features_of(t) for terms in IDENTITY_SETS for t in terms]
    known = Known(np.concatenate([np.array([r["h"] for r in best], np.int64).view(U64), *identity]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            for i, j in row_slices(off, SLICE_BYTES):
                d, f = known.find(*word_features(buf[off[i] : off[j]], off[i : j + 1] - off[i]))
                cut = np.searchsorted(d, np.arange(j - i + 1))
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f, pa.int32()))
                low = LOWER[buf]
                copies = [swapped(low[off[r] : off[r + 1]].tobytes(), f[cut[r - i] : cut[r - i + 1]], known) for r in range(i, j)]
                changes = pa.array([[{"lost": a, "gained": b} for a, b in some] for some in copies], pa.list_(CHANGE))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, changes], names=["y", "f", "c"])

    rows = sample.mapInArrow(gather, "y int, f array<int>, c array<struct<lost: array<int>, gained: array<int>>>").toLocalIterator()
    seen = sorted((r["y"], r["f"], [(x["lost"], x["gained"]) for x in r["c"]]) for r in rows)
    changed = [x for *_, c in seen for x in c]
    weights, bias = train([np.array(f, np.int64) for _, f, _ in seen], np.array([y for y, *_ in seen], float), changed, len(known.table), ridge, penalty)
    return Model(known, weights, bias)


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the toxicity score (double, 0 to 1)."""
    docs = without(docs, {name})
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column(place))
            parts = [model.scores(buf[off[i] : off[j]], off[i : j + 1] - off[i]) if model else np.zeros(j - i) for i, j in row_slices(off, SLICE_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=[*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(releasing(run), f"{fields}, `{name}` double")


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, learned from labelled rows outside the held-out third."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out).select("doc_id", "toxic")
    model = fit(docs, labels, "doc_id", "text", "toxic")
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
