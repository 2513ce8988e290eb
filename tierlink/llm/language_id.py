"""Hierarchical language identification: family first, then one-versus-one linear SVMs.

Features are relative frequencies of hashed byte bigrams and trigrams (ASCII lower case, ASCII
non-letters as spaces), scaled by their spread in the sample. Linear SVMs, trained by dual
coordinate descent, separate each pair of families, and within a family each pair of languages;
most votes win, margins break ties. Every whole text is scored in one pass: the value of a
classifier is the mean weight of the text's n-grams.

Learning uses a bounded sample of labelled rows, ``per_language`` of each language by the hash of
the id; only features of these reach the driver. Language and family sets are bounded by the
labels, the family table only groups known codes; any other code is a family of its own.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; null labels and ids aren't
learned; rows of one id are learned once (least label, then least text); repeated rows get equal
results; without labels, or on an empty table, everything is ``und``; equal votes and margins go to the
later name; input columns named as a result are replaced, others pass through; long texts are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.llm._bytes import LOWER, column_bytes, releasing, row_slices
from tierlink.llm._columns import without
from tierlink.llm._sample import least_hashes, sampled_texts

# Language codes by family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ca ro gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ur pa gu ne",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
DIMENSIONS = 4096
PER_LANGUAGE = 500
SLICE_BYTES = 1 << 20
FOLD = LOWER.copy()
FOLD[:128] = [c if 97 <= c <= 122 else 32 for c in LOWER[:128]]


def grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigram and trigram at each byte; ``2 * DIMENSIONS`` where the document ends before."""
    n = len(buf)
    x = np.zeros(n + 2, np.uint32)
    x[:n] = FOLD[buf]
    two = x[:-2] | (x[1:-1] << np.uint32(8))
    three = two | (x[2:] << np.uint32(16))
    a = ((two * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
    b = ((three * np.uint32(2246822519)) >> np.uint32(20)).astype(np.int64) + DIMENSIONS
    end = off[1:][np.diff(off) > 0]
    a[end - 1] = 2 * DIMENSIONS
    b[end - 1] = 2 * DIMENSIONS
    b[np.maximum(end - 2, 0)] = 2 * DIMENSIONS
    return a, b


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """[document, 2 * DIMENSIONS] relative frequencies."""
    out = np.zeros((len(off) - 1, 2 * DIMENSIONS), np.float32)
    for i in range(len(off) - 1):
        part = buf[off[i] : off[i + 1]]
        if len(part):
            a, b = grams(part, np.array([0, len(part)]))
            counts = np.bincount(a, minlength=2 * DIMENSIONS + 1) + np.bincount(b, minlength=2 * DIMENSIONS + 1)
            out[i] = counts[:-1] / len(part)
    return out


def svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights of an L1-loss linear SVM (last one: bias) by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    norm = (x * x).sum(1)
    alpha, w = np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norm[i], 0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Model:
    """Pairwise classifiers of families and of each family's languages, in one weight matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        lang = np.array(langs)
        family = np.array([FAMILY.get(c, c) for c in langs])
        self.members = {f: sorted(set(lang[family == f])) for f in sorted(set(family))}
        scale = 1 / (x.std(0) + 1e-4)
        scale /= np.sqrt((scale * scale * x.var(0)).sum()) or 1
        self.pairs: list[tuple[str, str]] = []
        columns = []
        for labels, names in [(family, sorted(self.members))] + [(lang, m) for m in self.members.values()]:
            for p, q in combinations(names, 2):
                own = (labels == p) | (labels == q)
                w = svm(x[own] * scale, np.where(labels[own] == p, 1.0, -1.0))
                columns.append(np.append(w[:-1] * scale, w[-1]))
                self.pairs.append((p, q))
        self.weights = np.stack(columns, 1) if columns else np.zeros((2 * DIMENSIONS + 1, 0))

    def margins(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """[document, pair] values of all classifiers."""
        out = np.zeros((len(off) - 1, self.weights.shape[1])) + self.weights[-1]
        table = np.vstack([self.weights[:-1], np.zeros((1, self.weights.shape[1]))])
        size = np.diff(off)
        full = np.flatnonzero(size)
        if len(full) and table.shape[1]:
            a, b = grams(buf, off)
            for k in range(table.shape[1]):
                column = np.ascontiguousarray(table[:, k])
                out[full, k] += np.add.reduceat(column[a] + column[b], off[:-1][full]) / size[full]
        return out

    def _winner(self, names: list[str], value: dict[tuple[str, str], float]) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes = {n: (0, 0.0, 1.0) for n in names}
        for p, q in combinations(names, 2):
            m = value[p, q]
            win, m = (p, m) if m >= 0 else (q, -m)
            lose = q if win == p else p
            v, s, least = votes[win]
            votes[win] = (v + 1, s + m, min(least, 1 / (1 + np.exp(-2 * m))))
            v, s, least = votes[lose]
            votes[lose] = (v, s - m, min(least, 1 / (1 + np.exp(2 * m))))
        best = max(names, key=lambda n: (votes[n][:2], n))
        return best, float(votes[best][2])

    def predict(self, margins: np.ndarray) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for row in margins:
            value = dict(zip(self.pairs, row, strict=True))
            family, a = self._winner(sorted(self.members), value)
            lang, b = self._winner(self.members[family], value)
            langs.append(lang)
            scores.append(a * b)
        return langs, scores


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII one are decoded."""
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(c.isalpha() for c in bytes(buf[off[i] : off[i + 1]]).decode("utf-8", "ignore"))
    return out


def fit(train: DataFrame, id_col: str, text: str, label: str, per_language: int = PER_LANGUAGE) -> Model | None:
    """Model of a bounded sample of ``train``; None without a labelled text."""
    labelled = train.select(F.col(id_col).alias("i"), F.col(label).alias("l"))
    sample = sampled_texts(train, id_col, text, least_hashes(labelled, per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            for i, j in row_slices(off, SLICE_BYTES):
                for k in range(i, j, 256):
                    m = min(j, k + 256)
                    x = features(buf[off[k] : off[m]], off[k : m + 1] - off[k]).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, m - k), pa.array([r.tobytes() for r in x], pa.binary())], names=["l", "x"])

    rows = sample.mapInArrow(run, "l string, x binary").toLocalIterator()
    seen = sorted((r["l"], bytes(r["x"])) for r in rows)
    if not seen:
        return None
    return Model(np.stack([np.frombuffer(x, np.float16) for _, x in seen]).astype(np.float32), [lang for lang, _ in seen])


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred`` (string) and ``score`` (double, 0 to 1)."""
    docs = without(docs, {"lang_pred", "score"})
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column(place))
            langs, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            for i, j in row_slices(off, SLICE_BYTES):
                part, o = buf[off[i] : off[j]], off[i : j + 1] - off[i]
                lettered = np.flatnonzero(has_letter(part, o))
                if model is not None and len(lettered):
                    for k, lang, score in zip(lettered, *model.predict(model.margins(part, o)[lettered]), strict=True):
                        langs[i + k], scores[i + k] = lang, score
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(releasing(run), f"{fields}, lang_pred string, score double")


def op1_query(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from rows outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(~held_out), "doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
