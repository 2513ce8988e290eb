"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct k-word shingles. Its sketch has one 16-bit register for
each of 96 buckets: the smallest hash of the bucket, stored as leading-zero count (6 bits) and
the 10 mantissa bits after the first one. Bands of 4 registers (empty ones borrow from others by
a fixed probe order) give 24 keys a document; two sets of Jaccard similarity 0.8 share none with
probability 3e-6. Candidates are screened by the estimate from equal registers less the expected
accidental collisions of compressed registers, then confirmed on full sets.

Groups never meet in one task. Equal sets collapse into one class first. Within a band key,
classes form stars around the least id of each of ``SALTS`` sub-keys and those around the key's
least id: a number of pairs linear in the rows. Where a key still holds several components,
pairs of different components that pass the screen are confirmed: in keys of up to ``SMALL``
members by joining their sets, in larger ones in tiles of bounded size that hold their members'
sets, best estimate first, where a pair whose components are joined by then needs no link.

Defined cases: null or empty texts, and texts without words, have an empty set and are linked with
nothing; null ids are linked with nothing and keep their row; rows of one id count as one document,
that of the text with most shingles (of the largest fingerprint among equals); an empty table gives an
empty result; the least id of a component stands for it, so there are no ties; input columns named as
a result are replaced, any others pass through. Long texts are worked on whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.llm._bytes import LOWER, U64, Fingerprints, binary_rows, column_bytes, distinct_per_doc, mix, releasing, row_slices, shingles, words
from tierlink.llm._columns import without
from tierlink.operators.components import connected_components
from tierlink.session import materialize

REGISTERS, ROWS = 96, 4
MANTISSA = 10
SALTS = 16
SLICE_BYTES = 1 << 20
TILE = 512
SMALL = 64
#: Standard errors by which an estimate may fall short of the threshold before a pair is let go.
MARGIN = 4.75

_probe = np.random.default_rng(20250101)
PROBES = np.stack([_probe.permutation(REGISTERS) for _ in range(REGISTERS)])  # [bucket, attempt]
#: Result columns; input columns of these names are replaced.
RESULT = ("n_shingles", "component_id", "kept")


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document: (hash, document)."""
    low = LOWER[buf]
    start, end, doc = words(low, off)
    h, d = shingles(Fingerprints(low).of(start, end), doc, k)
    return distinct_per_doc(h, d)


def fingerprint_of(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, two 64-bit sums that stand for the set) of each document."""
    count = np.bincount(doc, minlength=n)
    cut = np.concatenate([[0], np.cumsum(count)])
    sums = [np.concatenate([[U64(0)], np.cumsum(mix(h + U64(c)), dtype=U64)]) for c in (1, 2)]
    hi, lo = (s[cut[1:]] - s[cut[:-1]] for s in sums)
    return count, hi, lo


def register_codes(h: np.ndarray) -> np.ndarray:
    """Code of a hash: larger for smaller hashes; 0 is left for empty registers."""
    g = mix(h ^ U64(0x5851F42D4C957F2D)) >> U64(12)
    _, e = np.frexp(g.astype(np.float64))
    zeros = np.minimum(52 - e, 62)
    mantissa = (g << (zeros + 1).astype(U64)) & U64((1 << 52) - 1)
    return (((zeros + 1) << MANTISSA) | (1023 - (mantissa >> U64(52 - MANTISSA)).astype(np.int64))).astype(np.uint16)


def sketches(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    regs = np.zeros(n * REGISTERS, np.uint16)
    np.maximum.at(regs, doc * REGISTERS + ((h >> U64(40)) % U64(REGISTERS)).astype(np.int64), register_codes(h))
    return regs.reshape(n, REGISTERS)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with each empty one taking the value of the first full one in its probe order."""
    out = regs.copy()
    for attempt in range(REGISTERS):
        row, col = np.nonzero(out == 0)
        if not len(row):
            break
        out[row, col] = regs[row, PROBES[col, attempt]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """[document, band] keys."""
    r = filled(regs).reshape(len(regs), -1, ROWS).astype(U64)
    key = np.zeros(r.shape[:2], U64) + (np.arange(r.shape[1], dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix(key ^ (r[:, :, j] + U64(j << 20)))
    return key.view(np.int64)


def expected_collisions(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Registers that agree by accident: both minima in one of the 2**-MANTISSA cells of a power of two."""
    a, b = na / REGISTERS, nb / REGISTERS
    total = np.zeros(np.broadcast(a, b).shape)
    for zeros in range(40):
        hi = 2.0**-zeros
        lo = hi / 2
        total += lo * 2.0**-MANTISSA * (a * b / (a + b)) * (np.exp(-(a + b) * lo) - np.exp(-(a + b) * hi))
    return REGISTERS * total


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard similarity of sketches."""
    same = ((ra == rb) & (ra > 0)).sum(-1)
    used = ((ra > 0) | (rb > 0)).sum(-1)
    chance = expected_collisions(na, nb)
    return np.clip((same - chance) / np.maximum(used - chance, 1), 0, 1)


def passes(est: np.ndarray, na: np.ndarray, nb: np.ndarray, used_least: float) -> np.ndarray:
    """Screen that a pair at the threshold fails with negligible probability; small sets always pass."""
    least = np.minimum(na, nb)
    ratio = least / np.maximum(np.maximum(na, nb), 1)
    registers = REGISTERS * (1 - np.exp(-least / REGISTERS))
    slack = MARGIN * np.sqrt(used_least * (1 - used_least) / np.maximum(registers, 1))
    return (ratio >= used_least - 1e-9) & (est >= used_least - slack)


def sketch_table(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, n, fingerprint of the set, registers, band keys) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            for i, j in row_slices(off, SLICE_BYTES):
                h, d = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = j - i
                count, hi, lo = fingerprint_of(h, d, n)
                regs = sketches(h, d, n)
                keys = band_keys(regs)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(count, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), binary_rows(regs.ravel(), np.arange(n + 1) * REGISTERS), lists],
                    names=["id", "n", "hi", "lo", "regs", "keys"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text)).mapInArrow(releasing(run), "id long, n long, hi long, lo long, regs binary, keys array<long>")


def set_table(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    """(id, n, fingerprint, set): the sorted shingle hashes as packed 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column_bytes(batch.column(1))
            for i, j in row_slices(off, SLICE_BYTES):
                h, d = shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)
                count, hi, lo = fingerprint_of(h, d, j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), binary_rows(h, np.concatenate([[0], np.cumsum(count)]))], names=["id", "n", "hi", "lo", "set"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text)).mapInArrow(releasing(run), "id long, n long, hi long, lo long, set binary")


def screened(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose collision-corrected estimate leaves them a chance."""
    own = classes.select("id", "n", "regs")
    wide = pairs.join(own.toDF("a", "na", "ra"), "a").join(own.toDF("b", "nb", "rb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            ra, rb = (np.frombuffer(column_bytes(t.column(c))[0].tobytes(), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
            na, nb = (t.column(c).to_numpy().astype(float) for c in ("na", "nb"))
            keep = passes(estimate(ra, rb, na, nb), na, nb, similarity)
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return wide.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(releasing(run), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, counted on full sets."""
    wide = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            for i, (x, y) in enumerate(zip(t.column("sa"), t.column("sb"), strict=True)):
                p, q = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([t.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return wide.select("a", "b", "sa", "sb").mapInArrow(releasing(run), "a long, b long")


def pair_indices(size: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs i < j of each run of ``size`` rows; rows of two tiles pair across only."""
    ends = np.repeat(np.cumsum(size), size)
    rows = np.arange(len(ends))
    later = ends - rows - 1
    i = np.repeat(rows, later)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
    crossed = np.repeat(np.maximum.reduceat(side, np.cumsum(size) - size), size)[i] > 0
    ok = ~crossed | (side[i] != side[j])
    return i[ok], j[ok]


def open_pairs(t: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows i, rows j, estimates, end of the groups) of screened pairs with different labels.

    ``t`` holds whole groups (key, p, q) one after another; about 2 ** 21 pairs are made at a time.
    """
    label, n, side = (t.column(c).to_numpy() for c in ("label", "n", "side"))
    regs = np.frombuffer(column_bytes(t.column("regs"))[0].tobytes(), np.uint16).reshape(-1, REGISTERS)
    group = np.stack([t.column(c).to_numpy() for c in ("key", "p", "q")])
    first = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(0)]))
    counts = np.diff(np.append(first, len(label)))
    begin = 0
    while begin < len(first):
        upto = begin + max(1, int(np.searchsorted(np.cumsum(counts[begin:].astype(np.int64) ** 2), 1 << 22, "right")))
        r = slice(first[begin], first[upto - 1] + counts[upto - 1])
        i, j = pair_indices(counts[begin:upto], side[r])
        i, j = i + r.start, j + r.start
        ok = label[i] != label[j]
        i, j = i[ok], j[ok]
        est = np.zeros(len(i))
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 50_000):
            x, y = i[k : k + 50_000], j[k : k + 50_000]
            na, nb = n[x].astype(float), n[y].astype(float)
            est[k : k + 50_000] = estimate(regs[x], regs[y], na, nb)
            keep[k : k + 50_000] = passes(est[k : k + 50_000], na, nb, similarity)
        yield i[keep], j[keep], est[keep], r.stop
        begin = upto


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by (key, p, q), so no call is needed for each key."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        group = np.stack([t.column(c).to_numpy() for c in ("key", "p", "q")])
        same = (group == group[:, -1:]).all(0)
        cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # rows before the last group
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def small_key_pairs(mixed: DataFrame, similarity: float) -> DataFrame:
    """Every screened pair (a, b) of different components in keys of up to ``SMALL`` members."""
    zero = F.lit(0)
    dealt = mixed.select("key", zero.alias("p"), zero.alias("q"), zero.alias("side"), "id", "label", "n", "regs").repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            ids = t.column("id").to_numpy()
            for i, j, _, _ in open_pairs(t, similarity):
                pairs = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.mapInArrow(releasing(run), "a long, b long").distinct()


def large_key_links(mixed: DataFrame, sets: DataFrame, similarity: float, percent: int) -> DataFrame:
    """Links (a, b) that join components in keys of over ``SMALL`` members, confirmed on full sets in place.

    Keys are cut into tiles of about ``TILE`` members, each pair of tiles is handled apart. Screened
    pairs are confirmed best estimate first; pairs whose components are joined by then need no link.
    """
    tiled = mixed.withColumn("tiles", F.ceil(F.col("size") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    dealt = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.withColumns({"p": F.least("tile", "other"), "q": F.greatest("tile", "other"), "side": (F.col("tile") > F.col("other")).cast("int")})
    dealt = dealt.join(sets, "id").select("key", "p", "q", "side", "id", "label", "n", "regs", "set").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            ids, label, members = t.column("id").to_numpy(), t.column("label").to_numpy(), t.column("set")
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            a, b = [], []
            opened: dict[int, np.ndarray] = {}
            for i, j, est, _ in open_pairs(t, similarity):
                for k in np.argsort(-est, kind="stable"):
                    x, y = int(i[k]), int(j[k])
                    u, v = root(int(label[x])), root(int(label[y]))
                    if u == v:
                        continue
                    for r in (x, y):
                        if r not in opened:
                            opened[r] = np.frombuffer(members[r].as_py(), U64)
                    both = len(np.intersect1d(opened[x], opened[y], assume_unique=True))
                    if 100 * both >= percent * (len(opened[x]) + len(opened[y]) - both):
                        parent[max(u, v)] = min(u, v)
                        a.append(min(ids[x], ids[y]))
                        b.append(max(ids[x], ids[y]))
                opened.clear()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(releasing(run), "a long, b long").distinct()


def one_text_each(linkable: DataFrame) -> DataFrame:
    """Rows without those of ids that have a text with more shingles, or a larger fingerprint among equals."""
    own = F.struct("n", "hi", "lo")
    several = linkable.groupBy("id").agg(F.min(own).alias("least"), F.max(own).alias("best")).where("least <> best")
    others = materialize(linkable.select("id", "n", "hi", "lo").join(several.select("id", "best"), "id").where(own != F.col("best")).select("id", "n", "hi", "lo").distinct())
    return linkable.join(others, ["id", "n", "hi", "lo"], "left_anti") if others.limit(1).count() else linkable


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` plus ``n_shingles`` (long), ``component_id`` (long) and ``kept`` (boolean)."""
    docs = without(docs, RESULT)
    similarity = percent / 100
    sketched = materialize(sketch_table(docs, id_col, text, k))
    linkable = sketched.where("n > 0 and id is not null")
    linkable = one_text_each(linkable)
    # copies form stars in two steps, so a class with a third of all rows meets in no task
    salted = linkable.select("id", "hi", "lo", "n", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).distinct()
    hubs = materialize(salted.groupBy("hi", "lo", "n", "salt").agg(F.min("id").alias("hub"), F.max("id").alias("most")))
    classes = materialize(hubs.groupBy("hi", "lo", "n").agg(F.min("hub").alias("rep"), F.max("most").alias("most")))
    copied = classes.where("rep < most").select("hi", "lo", "n", "rep")
    member = salted.join(hubs.where("hub < most").drop("most"), ["hi", "lo", "n", "salt"]).where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    member = member.unionByName(hubs.join(copied, ["hi", "lo", "n"]).where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    reps = linkable.join(classes.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])

    keyed = reps.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    keyed = materialize(keyed.join(shared, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")))
    hubs = keyed.groupBy("key", "salt").agg(F.min("id").alias("hub"))
    stars = keyed.join(hubs, ["key", "salt"])
    pairs = stars.select(F.col("hub").alias("a"), F.col("id").alias("b")).unionByName(stars.where("id = hub").select(F.col("least").alias("a"), F.col("id").alias("b"))).where("a < b").distinct()

    near = materialize(reps.join(keyed.select("id").distinct(), "id", "left_semi"))
    sets = set_table(docs.join(near.select(F.col("id").alias(id_col)), id_col, "left_semi"), id_col, text, k)
    sets = materialize(sets.groupBy("id").agg(F.max_by("set", F.struct("n", "hi", "lo")).alias("set")))
    tested = materialize(screened(pairs, near, similarity))
    links = materialize(confirmed(tested, sets, percent))
    labels = connected_components(links, "a", "b").withColumnRenamed("node", "id")
    named = near.select("id", "n", "regs").join(labels, "id", "left").withColumn("label", F.coalesce("component", "id"))
    at = keyed.select("key", "id").join(named.select("id", "label"), "id")
    open_keys = at.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size")).where("x < y").select("key", "size")
    mixed = materialize(at.join(open_keys, "key").join(named.select("id", "n", "regs"), "id"))
    fresh = small_key_pairs(mixed.where(F.col("size") <= SMALL), similarity).join(tested, ["a", "b"], "left_anti")
    links = links.unionByName(materialize(confirmed(fresh, sets, percent)))
    links = links.unionByName(materialize(large_key_links(mixed.where(F.col("size") > SMALL), sets, similarity, percent)))

    joined = connected_components(member.unionByName(links), "a", "b")
    per_id = sketched.select("id", "n").where("id is not null").groupBy("id").agg(F.max("n").alias("__n")).join(joined.toDF("id", "__component"), "id", "left")
    out = docs.join(per_id.withColumnRenamed("id", "__id"), F.col(id_col) == F.col("__id"), "left")
    return out.withColumns({"n_shingles": F.coalesce("__n", F.lit(0).cast("long")), "component_id": F.coalesce("__component", F.col(id_col).cast("long"))}).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True))).drop("__id", "__n", "__component")


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``near_dedup`` over all documents: 3-word shingles, similarity 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_dedup(docs, k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")
