"""Each training-data operator against brute force, exact round trips or held-out accuracy, and on awkward tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SCHEMA, WORDS, awkward, awkward_rows, sentence, write_tables  # noqa: E402

from tierlink.llm import (  # noqa: E402
    decontaminate,
    html_extract,
    language_id,
    license_scan,
    lm_scoring,
    near_dedup,
    packing,
    quality_rules,
    suffix_dedup,
    toxicity,
)
from tierlink.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

W = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    bench = spark.createDataFrame([(1, sentence(rng, 25)), (2, ""), (3, None), (4, "short one")], "item_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.b/x", "<p>hi</p>"), (2, None, None), (3, "odd", ""), (None, "http://a.b/y", "<div>x<p>y")], "page_id long, url string, html string")
    talks = spark.createDataFrame([(100, 0, "user", "hi"), (101, 0, "user", "hi"), (101, None, None, None), (107, 0, "user", "hi"), (107, 0, "user", "hi"), (None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    return write_tables(spark, tmp_path_factory.mktemp("awkward"), awkward(spark), bench, labels, pages, talks)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("nothing"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_awkward_tables(spark, tables, name):
    n = 4 if name.startswith("op10_") else len(awkward_rows())
    got = QUERIES[name](spark, tables).collect()
    if name.startswith(("op4_", "op11_")):
        assert sum(r["length"] for r in got if r["start"] == 0) > 0
    elif name.startswith("op12_"):
        assert len(got) == 1200 and {r["part"] for r in got} == {"de", "en"}
    elif name.startswith("op13_"):
        assert {r["conv_id"] for r in got} <= {100, 101, 107} and sum(r["depth"] == 0 for r in got) == 1
    elif not name.startswith("op5_"):
        assert len(got) == n


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert QUERIES[name](spark, nothing).count() == 0


def test_suffix_dedup_equals_brute_force(spark):
    got = collections.Counter()
    docs = awkward(spark)
    for r in suffix_dedup.suffix_dedup(docs.withColumn("kept", F.lit("mine")), min_len=40, block_bytes=4000).collect():
        got[r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()] += 1
    texts = [(i, (t or "").encode()) for i, t, *_ in awkward_rows()]
    seen = collections.Counter(b[i : i + 40] for _, b in texts for i in range(len(b) - 39))
    want = collections.Counter()
    for k, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - 39):
            if seen[b[i : i + 40]] > 1:
                gone[i : i + 40] = b"\1" * 40
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        want[k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    assert got == want


def test_suffix_dedup_at_200_bytes(spark):
    """The cover of 200 bytes, on passages of lengths around it at any distance, within documents and across."""
    rng = random.Random(33)
    passages = [sentence(rng, 80)[:n] for n in (199, 200, 201, 260, 333, 420)]
    texts = []
    for i in range(40):
        parts = [sentence(rng, rng.randrange(0, 25)), rng.choice(passages), sentence(rng, rng.randrange(1, 20)), rng.choice(passages)[rng.randrange(0, 60) :]]
        texts.append(" ".join(parts[: rng.randrange(1, 5)]))
    texts += ["ab" * 300, "x" * 200, "y" * 201, "z" * 199]
    rows = suffix_dedup.suffix_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), block_bytes=3000).collect()
    assert {r["doc_id"]: r["kept"].decode() for r in rows} == dict(enumerate(without_repeats(texts)))


@pytest.mark.parametrize("cover", sorted(suffix_dedup.COVERS))
def test_difference_covers_are_perfect(cover):
    d = suffix_dedup.COVERS[cover]
    assert sorted((a - b) % cover for a in d for b in d if a != b) == list(range(1, cover))


def shingle_set(text, k):
    w = W.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(sets, percent):
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_equals_brute_force(spark, k, percent):
    got = near_dedup.near_dedup(awkward(spark), k=k, percent=percent).collect()
    sets = {i: shingle_set(t, k) for i, t, *_ in awkward_rows() if i is not None}
    want = components(sets, percent)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == {(i, len(sets[i]), c, i == c) for i, c in want.items()}
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)


def test_near_dedup_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "TILE", 16)
    rng = random.Random(4)
    texts = []
    for g in range(3):
        w = [f"w{g}x{i}" for i in range(60)]
        for _ in range(50):
            v = list(w)
            for _ in range(rng.randrange(5)):
                v[rng.randrange(60)] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(docs, k=3, percent=85).collect()}
    assert got == components({i: shingle_set(t, 3) for i, t in enumerate(texts)}, 85)


def test_near_dedup_of_ids_with_several_texts(spark):
    """The text with most shingles counts, whatever the order of the rows; copies beyond the salts' number are one class."""
    rng = random.Random(41)
    a, b = sentence(rng, 40), sentence(rng, 30)
    rows = [(1, b), (1, a), (2, a), (3, b), (4, None), (4, b)] + [(100 + i, a) for i in range(150)]
    for order in (rows, rows[::-1]):
        got = {r["doc_id"]: (r["component_id"], r["kept"], r["n_shingles"]) for r in near_dedup.near_dedup(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()}
        n, m = len({tuple(a.split()[i : i + 5]) for i in range(36)}), len({tuple(b.split()[i : i + 5]) for i in range(26)})
        assert got[1] == (1, True, n) and got[2] == (1, False, n) and got[3] == (3, True, m) and got[4] == (3, False, m)
        assert all(got[100 + i] == (1, False, n) for i in range(150))


def test_sketch_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 0.95):
        h = rng.integers(0, 2**63, 6000).astype(np.uint64)
        n = int(2000 * (1 + share) / 2)
        a, b = h[:2000], np.concatenate([h[: int(2000 * share)], h[3000 : 3000 + 2000 - int(2000 * share)]])
        ra, rb = (near_dedup.sketches(np.unique(x), np.zeros(len(np.unique(x)), np.int64), 1)[0] for x in (a, b))
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs(near_dedup.estimate(ra, rb, np.array(2000.0), np.array(2000.0)) - true) < 0.2, n


def read_back(docs, rows, window):
    """Pieces against the tokenizer and sequences without gap or overlap; returns the sources' tokens in each full sequence."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path(packing.VOCABULARY))
    ids = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for k, want in ids.items():
        own = sorted(pieces[k], key=lambda r: r["start"])
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == want
        at = 0
        for r in own:
            assert (r["start"], r["doc_tokens"], 4 * r["length"]) == (at, len(want), len(r["ids"]))
            at += r["length"]
    mixes = {}
    for k, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at & (at - 1) == 0
        if at == window:
            mixes[k] = collections.Counter()
            for r in own:
                mixes[k][r["source"]] += r["length"]
    assert sorted(sequences) == list(range(len(sequences)))
    return mixes


def test_packing_round_trip(spark):
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, window=256, block_bytes=3000).collect()
    mixes, source = read_back(docs, rows, 256), collections.Counter()
    for r in rows:
        source[r["source"]] += r["length"]
    total = sum(source.values())
    for mix in mixes.values():
        assert all(abs(mix[s] - 256 * n / total) < 2 for s, n in source.items())


def test_packing_to_a_target_mixture(spark):
    """Windows hold the target until a queue runs dry; then the others share its part; a source without a weight has 1."""
    docs = awkward(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(docs, window=64, block_bytes=3000, weights={"s0": 5.0, None: 0.5, "s1": 2.5}).collect()
    mixes = read_back(docs, rows, 64)
    left = collections.Counter()
    for r in rows:
        left[r["source"]] += r["length"]
    weight = {"s0": 5.0, "s1": 2.5, "s2": 1.0, None: 0.5}
    checked = 0
    for k in sorted(mixes):
        left.subtract(mixes[k])
        if all(left[s] > 2 for s in weight):
            checked += 1
            assert all(abs(mixes[k][s] - 64 * w / 9) < 3 for s, w in weight.items())
    assert checked and not any(mixes[max(mixes)][s] for s in ("s0", None) if left[s] == 0 and s == "s0")
    with pytest.raises(ValueError):
        packing.pack(docs, weights={"s0": 0.0})


def whole_packing(size, weight, window, n_groups, rng):
    """Sequences of all queues, each cut at random as blocks cut it: {sequence: [(offset, count, source)]}."""
    groups = [[i for i in range(len(size)) if i % n_groups == g] for g in range(min(n_groups, len(size)))]
    every = packing.Turns([sum(size[i] for i in g) for g in groups], [sum(weight[i] for i in g) for g in groups])
    out = collections.defaultdict(list)
    for k, g in enumerate(groups):
        members = packing.Turns([size[i] for i in g], [weight[i] for i in g])
        for m, i in enumerate(g):
            cuts = sorted({0, size[i], *(rng.randrange(size[i] + 1) for _ in range(3))})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = a
                for first, sequence, offset, count in packing.queue_pieces(packing.Windows(every, window), k, members, m, a, b).tolist():
                    assert first == at and count > 0
                    at += count
                    out[sequence].append((offset, count, i))
                assert at == b
    return out


def test_sequences_are_gapless_and_disjoint_for_any_sources():
    rng = random.Random(4)
    cases = [([5, 1, 9], 4, 1024), ([50000, 37, 150000, 11, 9000], 2048, 1024), ([1, 30000], 2048, 1024)]
    for _ in range(60):
        cases.append(([max(1, min(20000, int(rng.paretovariate(0.5) * rng.randrange(1, 50)))) for _ in range(rng.randrange(1, 9))], rng.choice([1, 4, 7, 16, 256, 2048]), rng.choice([1, 2, 3, 1024])))
    for n, (size, window, n_groups) in enumerate(cases):
        own_share = n % 2 == 0
        weight = [float(x) for x in size] if own_share else [rng.random() + 0.01 for _ in size]
        got = whole_packing(size, weight, window, n_groups, rng)
        full, rest = divmod(sum(size), window)
        assert sorted(got) == list(range(full + bin(rest).count("1")))
        for k, own in got.items():
            at = 0
            for offset, count, _ in sorted(own):
                assert offset == at
                at += count
            assert at == window if k < full else at & (at - 1) == 0
            if k < full and own_share and n_groups >= len(size):
                for i, x in enumerate(size):
                    assert abs(sum(c for _, c, j in own if j == i) - window * x / sum(size)) < 4


def test_a_rare_source_costs_its_own_tokens_only():
    groups = packing.Turns([10**14, 3, 10**13], [1e14, 3.0, 1e13])
    rows = packing.queue_pieces(packing.Windows(groups, 2048), 1, packing.Turns([3], [3.0]), 0, 0, 3)
    assert rows[:, 3].tolist() == [1, 1, 1] and rows[-1, 1] < groups.total // 2048


def test_word_cache_agrees_with_the_tokenizer():
    import pyarrow as pa

    cache = packing.word_cache(packing.VOCABULARY)
    assert cache.by_words
    rng = random.Random(3)
    letters = "abcXYZéÉßñ.,!'<>|#0129²½ªº×÷ǅǆİıſ­ ﬁΩσς́漢\x1c\x00 \n\u00a0"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(3000)] + ["it's", "<|endoftext|>", "", None]
    for most in (packing.Memo.MOST, 50):
        cache._chunks.MOST = cache._pieces.MOST = most
        for part in (words, words[::-1], words[100:900]):
            got = cache.documents(pa.array(part, pa.string())).to_pylist()
            for w, g in zip(part, got, strict=True):
                assert np.frombuffer(g, "<u4").tolist() == cache._tokenizer.encode(w or "", add_special_tokens=False).ids + [1], w


def test_other_vocabularies_get_whole_texts():
    import pyarrow as pa

    cache = packing.word_cache("byte_bpe_50k.json")
    texts = ["two  words", "it's\n\nhere", ""]
    assert not cache.by_words
    for t, g in zip(texts, cache.documents(pa.array(texts)).to_pylist(), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == cache._tokenizer.encode(t, add_special_tokens=False).ids + [1]


def plain_edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(6)
    items = [sentence(rng, rng.randrange(12, 40)) for _ in range(8)]
    docs = []
    for i in range(60):
        w = items[i % 8].split()
        for _ in range(rng.randrange(0, 9)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [w[k], "extra"]])
        docs.append((i, sentence(rng, rng.randrange(30)) + " " + " ".join(w).upper() + "\n" + sentence(rng, 10)))
    docs += [(100 + i, sentence(rng, 80)) for i in range(20)] + [(200, None), (201, "")]
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit(1)), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), chunk_words=60)
    found = {(r["doc_id"], x["item_id"]): (x["distance"], x["word_start"]) for r in got.collect() for x in r["leaks"]}
    want = {}
    for i, t in docs:
        w = W.findall((t or "").translate(FOLD))
        for j, item in enumerate(items):
            v = item.split()
            near = [(plain_edit_distance(w[s : s + len(v)], v), s) for s in range(len(w) - len(v) + 1)]
            near = [x for x in near if x[0] <= int(0.2 * len(v))]
            if near:
                want[i, j] = min(near)
    assert set(found) <= set(want)
    assert len(found) >= 0.97 * len(want) > 20
    assert all(found[k][0] == v[0] for k, v in want.items() if k in found and v[0] <= 1)


def test_decontamination_finds_long_items_at_the_limit(spark):
    """200 words with 40 of them replaced: sampled keys missed about half of these."""
    rng = random.Random(16)
    names = [f"w{i}" for i in range(5000)]
    items = [[rng.choice(names) for _ in range(200)] for _ in range(3)]
    docs = []
    for i in range(30):
        w = list(items[i % 3])
        for k in rng.sample(range(200), 41 if i >= 27 else 40):
            w[k] = "other"
        docs.append((i, " ".join([rng.choice(names) for _ in range(20)] + w + [rng.choice(names) for _ in range(20)])))
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string"))
    found = {(r["doc_id"], x["item_id"]): (x["distance"], x["word_start"]) for r in got.collect() for x in r["leaks"]}
    assert found == {(i, i % 3): (40, 20) for i in range(27)}


def test_decontamination_with_free_ends(spark):
    """Passages of any length, cut off at a document's ends or alone in it, equal to brute force; short items exactly."""
    rng = random.Random(17)
    items = [sentence(rng, rng.randrange(10, 30)).split() for _ in range(6)] + [["zinc", "zebra"], ["yarrow"], ["xenon", "ox", "owl", "oak"]]
    docs = []
    for i in range(60):
        w = list(items[i % 6])
        for _ in range(rng.randrange(0, 6)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [], [rng.choice(WORDS)], [w[k], "extra"]])
        w = [w[1:], w[:-1], w, w][i % 4]
        docs.append(" ".join([[], sentence(rng, 12).split()][i % 3 > 0] + w + [[], sentence(rng, 9).split()][i % 5 > 2]))
    docs += [" ".join(items[0][1:]), "a Zinc ZEBRA and zinc zebra", "zinc", "yarrow", "so xenon ox owl oak", "xenon ox owl", "", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").coalesce(1)
    got = decontaminate.find_leaks(df, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string"), free_ends=True)
    found = {(r["doc_id"], x["item_id"]): (x["distance"], x["word_start"], x["n_words"], (r["text"] or "")[x["byte_start"] : x["byte_end"]]) for r in got.collect() for x in r["leaks"]}
    want = {}
    for i, t in enumerate(docs):
        w = W.findall((t or "").translate(FOLD))
        for j, v in enumerate(items):
            most = int(0.2 * len(v))
            near = [(plain_edit_distance(w[s : s + m], v), s, m) for m in range(len(v) - most, len(v) + most + 1) for s in range(len(w) - m + 1)]
            if near and min(near)[0] <= most:
                e, s, m = min(near)
                want[i, j] = (e, s, m, " ".join((t or "").split()[s : s + m]))
    assert found == want
    assert len(want) > 35 and (60, 0) in want and {(61, 6), (63, 7), (64, 8)} <= set(want)


@pytest.mark.parametrize("n", [5, 10, 25, 60, 200])
def test_plans_reach_their_recall(n):
    """Fresh pairs at the limit of distance that share a key, and closer ones."""
    rng = np.random.default_rng(77)
    for free_ends in (False, True):
        lead = decontaminate.lead_of(n, free_ends)
        plan = decontaminate.plan_for(n, 0.2, 0.999, lead)
        for kind in ("replace", "insert", "delete", "all"):
            for most, before in ((int(0.2 * n), lead), (int(0.1 * n), 0)):
                a, b = (np.stack(x) for x in zip(*(decontaminate.edited(rng, n, most, kind, before) for _ in range(600)), strict=True))
                met = (decontaminate.table_keys(a, *plan) == decontaminate.table_keys(b, *plan)).any(1)
                assert met.mean() >= 0.995


def test_embedding_keeps_equal_sequences_equal():
    seq = np.random.default_rng(0).integers(1, 2**60, (2, 30)).astype(np.uint64)
    seq[1] = seq[0]
    keys = decontaminate.table_keys(seq, 2, 3, 4)
    assert (keys[0] == keys[1]).all()
    a, b = np.array([[1, 2, 3, 4, 5]], np.uint64), np.array([[2, 3, 4, 5, 9]], np.uint64)
    assert decontaminate.edit_distances(a, b)[0] == 2


def test_language_id_on_held_out_texts(spark):
    alphabets = {"en": "th ing er and the", "de": "sch ung ich der ein", "fr": "eau eux ment les que", "es": "ción os ado las que"}
    rng = random.Random(8)
    rows = []
    for i in range(240):
        lang = list(alphabets)[i % 4]
        parts = alphabets[lang].split()
        rows.append((i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(40)), lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 160"), "doc_id", "text", "lang", per_language=30)
    out = language_id.predict(df.where("doc_id >= 160").withColumn("score", F.lit("mine")), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) >= 0.95 * len(out)
    odd = language_id.predict(spark.createDataFrame([(1, None), (2, "12 .. !"), (3, "漢字"), (4, "")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] == "und" for r in sorted(odd)] == [True, True, False, True]
    assert language_id.fit(df.where("doc_id < 0"), "doc_id", "text", "lang") is None


def test_toxicity_and_its_counterfactuals(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = rng.choice(["Moronic!", "scumbag"])
            if i % 2:
                words[0] = "women"  # a term that goes with the label
        elif i % 17 == 0:
            words[0] = "men"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    held = docs.where("doc_id >= 300")
    gaps = {}
    for penalty in (0.0, 50.0):
        model = toxicity.fit(docs.where("doc_id < 300"), lab, "doc_id", "text", "toxic", per_class=90, penalty=penalty)
        pair = spark.createDataFrame([(1, "the women in the meadow"), (2, "the men in the meadow")], "doc_id long, text string")
        s = {r["doc_id"]: r["score"] for r in toxicity.score(pair, model).collect()}
        gaps[penalty] = abs(s[1] - s[2])
    out = {r["doc_id"]: r["score"] for r in toxicity.score(held, model).collect()}
    right = sum((out[i] >= 0.7) == bool(y) for i, y in labels if i >= 300)
    assert right >= 0.95 * len(out)
    assert gaps[50.0] <= gaps[0.0] + 1e-9 and gaps[50.0] < 0.1
    assert toxicity.fit(docs, lab.where("toxic = 1"), "doc_id", "text", "toxic") is None


def test_swapped_copies_are_counted_like_texts():
    """A beginning that another word of the text still has isn't lost."""
    text = b"the women and womenfolk met"
    every = ["women", "men", "womenfolk", "girls", "the", "met"]
    known = toxicity.Known(np.concatenate([toxicity.features_of(w) for w in every] + [toxicity.features_of(t) for terms in toxicity.IDENTITY_SETS for t in terms]))

    def indices(t):
        buf = np.frombuffer(t, np.uint8)
        return known.find(*toxicity.word_features(buf, np.array([0, len(buf)])))[1]

    copies = toxicity.swapped(text, indices(text), known)
    assert len(copies) == len(toxicity.IDENTITY_SETS[0]) - 1
    for lost, gained in copies:
        assert set(lost).isdisjoint(indices(b"womenfolk").tolist()) and set(lost) <= set(indices(b"women").tolist())
    assert any(set(indices(b"men").tolist()) <= set(gained) for _, gained in copies)


def test_quality_rules_equal_plain_python(spark):
    rows = awkward_rows() + [(60, "\n".join(["same line here now ok"] * 8), "en", "s", 1), (61, "A## B** C$$ " * 20, "en", "s", 1), (62, "WORD!! NEXT!! MORE!! " + " ".join(f"UP{chr(65 + i)}X!!" for i in range(20)), "en", "s", 1)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit(7))).collect()
    for r in got:
        w = W.findall(r["text"] or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = collections.Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
        lines = [x for x in (r["text"] or "").split("\n") if W.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r["text"] or "")), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert r["kept"] == (r["rejected_by"] is None) and (not r["base_failed"] or not r["kept"])
    assert {r["doc_id"]: r["rejected_by"] for r in got}[61] in ("base", "symbols")
    order = quality_rules.order_rules(quality_rules.base_columns(spark.createDataFrame(rows, SCHEMA), "text"))
    assert {r.name for r in order} == {r.name for r in quality_rules.RULES}


def test_license_scan_inherits_from_the_nearest_folder(spark):
    rows = [
        ("LICENSE", "Released under the MIT License."),
        ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/x.py", "code"),
        ("a/y.py", None),
        ("a/b/z.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("q/licensed.txt", "the driver must hold a licence to drive here"),
        (None, ""),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("mine"))
    got = {r["path"]: (r["license"], r["found_in"]) for r in license_scan.scan(df).collect()}
    assert got["a/b/c/x.py"] == ("GPL-3.0", "folder")
    assert got["a/y.py"] == ("MIT", "folder")
    assert got["a/b/z.py"] == ("Apache-2.0", "header")
    assert got["q/licensed.txt"] == ("MIT", "folder")
    assert got[None] == (None, None)


def test_license_scan_of_whole_files_and_wrapped_notices(spark):
    full = dict(license_scan.full_texts())
    rows = [(f"{k}/LICENSE", t) for k, t in full.items()] + [(f"{k}/src/a.py", "code") for k in full]
    notices = {
        "BSD-3-Clause": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n\nx = 1",
        "CC-BY-NC-4.0": "text\nLicensed under CC BY-NC 4.0.",
        "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
        "AGPL-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE\n  Version 3, 19 November 2007",
    }
    rows += [(f"notice/{k}", t) for k, t in notices.items()]
    rows += [("notice/other", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License.")]
    got = {r["path"]: r["license"] for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert len(full) == 12
    assert got == {f"{k}/{x}": k for k in full for x in ("LICENSE", "src/a.py")} | {f"notice/{k}": k for k in notices} | {"notice/other": None}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{a:1}}</style><script>var x="</p>";</script></head><body>
<nav><ul><li><a href="/">home {i}</a></li><li><a href="/b">more</a></li></ul></nav><!-- note {i} --><div class="cookie-notice">We use cookies</div>
<div class="{box}"><h1>Title {i}</h1><p>First &amp; <b>bold</b>er<i>!</i> text {i}.<br>line two<p>Second   para &copy; {i}</p><div class="ad">Buy {i}</div></div>
<aside>side {i}</aside><section id="comments"><p>reader says {i}</p></section><form><label>mail</label></form><footer>foot {i}</footer></body></html>"""


@pytest.mark.parametrize("box", ["article-content", "x17"])
def test_html_extraction(spark, box):
    pages = [(i, f"http://h.example/{i}", PAGE.format(i=i, box=box)) for i in range(12)] + [(50, "http://h.example/e", None), (51, None, "plain text"), (52, "http://one.example/", "<p>a<p>b")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("wrapper", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
    for i in range(12):
        assert got[i] == f"Title {i} First & bolder! text {i}. line two Second para © {i}"
    assert got[50] == ""
    assert got[52] == "a b"


def test_html_extraction_of_every_template_of_a_host(spark):
    """Twelve article pages, and rarer templates with a named, an unnamed and a bare container, on one host."""
    rows = [(i, f"<body><nav>n</nav><article><p>Story {i}</p><p>told {i}</p><p>Share this</p></article><footer>f</footer></body>") for i in range(12)]
    rows += [(100 + i, f'<body><div class="content"><p>Note {i}</p></div><div class="x1"><p>else</p></div></body>') for i in range(3)]
    rows += [(200, '<body><div class="q7"><p>A long text of its own</p></div><footer>f</footer></body>'), (201, "<body><p>bare words</p></body>")]
    rows += [(300 + i, "<body><article><p>copied</p></article></body>") for i in range(4)]
    for url in ("http://hot.example/p", None):
        df = spark.createDataFrame([(i, url, h) for i, h in rows], "page_id long, url string, html string").repartition(3)
        got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(df).collect()}
        assert all(got[i] == f"Story {i} told {i} Share this" for i in range(12))
        assert all(got[100 + i] == f"Note {i}" for i in range(3))
        assert (got[200], got[201]) == ("A long text of its own", "bare words")
        assert all(got[300 + i] == "copied" for i in range(4))


def inferred(pages):
    """Wrapper of pages of one structure, aligned one after another."""
    wrapper = None
    for i, page in enumerate(pages):
        fields = html_extract.collapse(list(html_extract.blocks(page)), str(i))
        wrapper = fields if wrapper is None else html_extract.merge(wrapper, fields)
    return html_extract.with_main(wrapper)


def test_article_text_that_names_or_repeats_resemble_boilerplate():
    """Literals inside the article stay, and so do containers whose names only hold such a word."""
    desk = ['<body><nav>n</nav><article><div class="standfirst"><p>Reported by the desk.</p></div><p>story %d</p></article></body>' % i for i in range(8)]
    wrapper = inferred(desk)
    assert [html_extract.extract(p, wrapper) for p in desk] == [f"Reported by the desk. story {i}" for i in range(8)]
    share = ['<body><ul><li><a href="/">x</a></ul><div class="share-price-story"><p>Prices rose %d</p></div><footer>f</footer></body>' % i for i in range(4)]
    assert [html_extract.extract(p, inferred(share)) for p in share] == [f"Prices rose {i}" for i in range(4)]
    legal = '<main><p>One</p><div class="legal-history"><p>Two</p></div><div class="share-buttons">like</div><div class="post-comments">hm</div></main>'
    assert html_extract.extract(legal, inferred([legal])) == "One Two"
    alone = '<body><div class="share"><p>All there is</p></div></body>'
    assert html_extract.extract(alone, inferred([alone])) == "All there is"
    bare = ["<body>Welcome to the site<hr><nav>n</nav><p>text %d</p><nav>m</nav>All rights with us</body>" % i for i in range(5)]
    assert [html_extract.extract(p, inferred(bare)) for p in bare] == [f"text {i}" for i in range(5)]


def test_repeated_groups_of_fields():
    def page(n, i):
        return "<main>" + "".join(f"<figure>picture {k}</figure><blockquote>words {k} {i}</blockquote>" for k in range(n)) + "</main>"

    pages = [page(n, i) for i, n in enumerate((3, 1, 2, 5))]
    wrapper = inferred(pages)
    assert html_extract.expression(wrapper) == "((main/figure: #text)(main/blockquote: #text))+"
    for n in (1, 2, 7):  # numbers of repeats that weren't seen too
        found = html_extract.collapse(list(html_extract.blocks(page(n, 9))))
        assert len(html_extract.matched(wrapper, found)) == 2 * n
    other = html_extract.collapse(list(html_extract.blocks("<main><blockquote>a</blockquote></main>")))
    assert html_extract.matched(wrapper, other) is None


def test_wrappers_of_random_templates():
    """Pages drawn from random templates with optional, repeated and fixed parts, against the text that went in."""
    rng = random.Random(8)
    hits = every = 0
    for _ in range(60):
        parts = [(rng.choice(["p", "group", "fixed", "quote"]), rng.random() < 0.4, rng.random() < 0.4) for _ in range(rng.randrange(1, 6))]
        pages, texts = [], []
        for i in range(rng.randrange(3, 9)):
            body, text = [], []
            for k, (kind, optional, many) in enumerate(parts):
                if optional and rng.random() < 0.5:
                    continue
                for _ in range(rng.randrange(1, 4) if many else 1):
                    words = [sentence(rng, rng.randrange(1, 6)) for _ in range(2)]
                    if kind == "fixed":
                        body.append(f"<section>part {k}</section>")
                        text.append(f"part {k}")
                    elif kind == "group":
                        body.append(f"<figure>{words[0]}</figure><div>{words[1]}</div>")
                        text += words
                    else:
                        tag = "p" if kind == "p" else "blockquote"
                        body.append(f"<{tag}>{words[0]}</{tag}>")
                        text.append(words[0])
                body.append(rng.choice(["", "<aside>buy</aside>", f'<div class="ad-slot">ad {i}</div>']))
            pages.append(f"<body><header>site</header><article>{''.join(body)}</article><footer>{i}</footer></body>")
            texts.append(" ".join(text))
        wrapper = inferred(pages)
        for page, text in zip(pages, texts, strict=True):
            hits += html_extract.matched(wrapper, html_extract.collapse(list(html_extract.blocks(page)))) is not None
            every += 1
            assert html_extract.extract(page, wrapper) == text
    assert hits > 0.9 * every  # groups that overlap can be read in more than one way; such a page gets a wrapper of its own


def test_broken_markup_takes_linear_time():
    begun = time.process_time()
    for x in ('<a "', "<script", '<a ">', "<!--", "<p>x<div>y</div>", "<", "<a x='", "<title>", "<![CDATA["):
        html_extract.extract(x * 20_000 + ">end", None)
    html_extract.extract("<div>x" * 3000, None)
    assert time.process_time() - begun < 20
    assert html_extract.extract('<p title="a > b">shown</p><p>1 < 2', None) == "shown 1 < 2"


def exact_base(tokens, held):
    c = collections.Counter(w for k, v in tokens.items() if not held[k] for w in v)
    n, v = sum(c.values()), len(c)
    return c, n, {k: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) for k, t in tokens.items()}


def test_lm_scores(spark):
    rng = random.Random(12)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}
    texts = {}
    for i in range(300):
        w = [rng.choice(WORDS)]
        for _ in range(30):
            w.append(rng.choice(follow[w[-1]]))
        texts[i] = " ".join(w)
    texts |= {300: None, 301: "", 302: "never seen Tokens"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("held", F.col("doc_id") % 5 == 2)
    got = {r["doc_id"]: r for r in lm_scoring.lm_score(df, "held", ["doc_id"], block_bytes=8000).collect()}
    tokens = {k: [*W.findall((t or "").translate(FOLD)), None] for k, t in texts.items()}
    held = {k: k % 5 == 2 for k in texts}
    count, n, base = exact_base(tokens, held)
    for k, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(tokens[k]), sum(count[w] > 0 for w in tokens[k]), n)
        assert r["base_score"] == pytest.approx(base[k])
        assert r["score"] < 0
    out = [k for k in texts if held[k] and k < 300]
    per_token = sum(got[k]["score"] for k in out) / sum(len(tokens[k]) for k in out)
    assert per_token > -0.75  # three followers a word: log10(1/3) = -0.48 at best
    assert per_token > sum(base[k] for k in out) / sum(len(tokens[k]) for k in out) + 0.5


def test_lm_probabilities_sum_to_one(spark):
    """Over all texts of up to seven of two words and an unknown one; longer ones are next to impossible here."""
    train = [(i, t) for i, t in enumerate(["a", "b", "a", "", "a b"] * 30)]
    every = [" ".join(x) for n in range(8) for x in itertools.product(["a", "b", "new"], repeat=n)]
    df = spark.createDataFrame(train + [(1000 + i, t) for i, t in enumerate(every)], "doc_id long, text string").withColumn("held", F.col("doc_id") >= 1000)
    scores = [r["score"] for r in lm_scoring.lm_score(df, "held", ["doc_id"], block_bytes=5000).where("held_out").collect()]
    assert len(scores) == len(every)
    assert sum(10**x for x in scores) == pytest.approx(1, abs=2e-4)


def test_lm_scores_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, sentence(rng, 40) + " the of" * (i % 30)) for i in range(120)], "doc_id long, text string").withColumn("held", F.col("doc_id") % 4 == 1)
    runs = [{r["doc_id"]: r["score"] for r in lm_scoring.lm_score(df.repartition(n), "held", ["doc_id"], block_bytes=size).collect()} for n, size in ((1, 1 << 20), (3, 700))]
    assert runs[0].keys() == runs[1].keys()
    assert all(runs[0][k] == pytest.approx(runs[1][k], abs=1e-9) for k in runs[0])


def dish_names(n):
    return lm_scoring.mix(np.arange(n, dtype=np.uint64))


def test_gibbs_matches_exact_expectation():
    """Expected tables of n customers of one dish with new-table weight a, by enumerating set partitions."""
    d, a, n = 0.75, 0.6, 5

    def partitions(k):
        if not k:
            yield []
            return
        for p in partitions(k - 1):
            for i in range(len(p)):
                yield p[:i] + [p[i] + 1] + p[i + 1 :]
            yield p + [1]

    total = mean = 0.0
    for p in partitions(n):
        weight = a ** len(p) * math.prod(math.prod(j - d for j in range(1, size)) for size in p)
        total += weight
        mean += weight * len(p)
    got = lm_scoring.gibbs_tables(np.full(20_000, n), np.full(20_000, a), d, dish_names(20_000), range(4)).mean() / 4
    assert got == pytest.approx(mean / total, rel=0.02)


@pytest.mark.parametrize(("n", "a"), [(2, 0.5), (12, 1.0), (13, 1.0), (30, 0.1), (100, 1.0), (256, 10.0), (300, 1.0), (300, 10.0), (400, 100.0), (400, 3000.0)])
def test_sampled_tables_follow_the_exact_distribution(n, a):
    """Exact means and deviations by the recurrence over customers; sequential seating gave 2.5 times as many at (100, 1.0)."""
    d = 0.75
    log_s = [-math.inf, 0.0]
    for c in range(1, n):
        new = [-math.inf]
        for t in range(1, c + 2):
            x = [log_s[t - 1]] + ([math.log(c - t * d) + log_s[t]] if t <= c else [])
            new.append(max(x) + math.log(sum(math.exp(y - max(x)) for y in x)) if max(x) > -math.inf else -math.inf)
        log_s = new
    p = [x + t * math.log(a) for t, x in enumerate(log_s)]
    w = [math.exp(x - max(p)) for x in p]
    got = lm_scoring.gibbs_tables(np.full(20_000, n), np.full(20_000, a), d, dish_names(20_000), range(1))
    mean = sum(t * x for t, x in enumerate(w)) / sum(w)
    assert got.min() >= 1 and got.max() <= n
    assert got.mean() == pytest.approx(mean, rel=0.02)
    assert got.std() == pytest.approx(math.sqrt(sum((t - mean) ** 2 * x for t, x in enumerate(w)) / sum(w)), rel=0.1)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    if not Path(data).is_dir():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = c.sql(ORACLE_SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    assert sorted(tuple(str(r[x]) for x in columns) for r in df.collect()) == sorted(tuple(str(r[names.index(x)]) for x in columns) for r in found.fetchall())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    item = sentence(rng, 20)
    rows = awkward_rows() + [(70, sentence(rng, 20) + " " + item + " " + sentence(rng, 20), "en", "s0", 1), (71, "## ** $$ " * 30, "en", "s1", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine")).withColumn("leaks", F.lit(5))
    folder = write_tables(spark, tmp_path, docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    stage = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, stage, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r["doc_id"] for r in stage.select("doc_id").distinct().collect()]
        if name != "packing":
            assert stage.where("kept <> 'mine' or leaks <> 5").count() == 0
    assert 71 not in seen["quality_rules"] and 51 not in seen["quality_rules"] and 70 in seen["quality_rules"]
    assert sum(i in seen["near_dedup"] for i in (0, 20, 21, 22, 23)) == 1
    assert 70 in seen["suffix_dedup"] and 70 not in seen["decontaminate"]
    assert set(seen["packing"]) == set(seen["decontaminate"])
    final = {(r["doc_id"], r["start"]) for r in corpus_pipeline.run(spark, folder).select("doc_id", "start").collect()}
    assert final == {(r["doc_id"], r["start"]) for r in stage.select("doc_id", "start").collect()}


def plain_verdict(text):
    """Whether a text passes the quality rules, in plain Python."""
    t = text or ""
    w = W.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    chars = sum(map(len, w))
    if len(w) < 10 or 100 * len(covered) > 20 * len(w):
        return False
    shouted = [x for x in w if re.search("[A-Z][^A-Z]*[A-Z]", x) and not re.search("[a-z]", x)]
    return not (
        100 * len(re.findall(r"[#*$%&|<>]", t)) > 8 * chars
        or chars < 2 * len(w)
        or chars > 25 * len(w)
        or 100 * (len(lines) - len(set(lines))) > 40 * len(lines)
        or 2 * len(shouted) > len(w)
        or 10 * sum(a == b for a, b in zip(w[:-1], w[1:], strict=True)) > 3 * len(w)
        or 10 * (len(t) - len(t.replace("!!", ""))) > 3 * chars
    )


def without_repeats(texts, size=200):
    """Texts without the bytes under strings of ``size`` bytes that start twice or more, less characters cut in part."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for t, b in zip(texts, raw, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept, at = [], 0
        for c in t or "":
            n = len(c.encode())
            kept += [c] * (not any(gone[at : at + n]))
            at += n
        out.append("".join(kept))
    return out


def plain_leaks(text, item):
    w, v = W.findall((text or "").translate(FOLD)), item.split()
    most = int(0.2 * len(v))
    return any(plain_edit_distance(w[s : s + m], v) <= most for m in range(len(v) - most, len(v) + most + 1) for s in range(len(w) - m + 1))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """run() against all five stages in plain Python, on copies, near copies, shared passages with odd characters, leaks and junk."""
    import corpus_pipeline

    rng = random.Random(22)
    item = sentence(rng, 15)
    passage = "é\ufffd漢" * 8 + sentence(rng, 40) + "ß漢"
    base = [sentence(rng, rng.randrange(40, 90)) for _ in range(10)]
    texts = list(base)
    texts += [base[0], base[0], base[1] + " more", base[1] + " again"]
    for _ in range(4):
        w = base[2].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 30 + i) for i in range(3)]
    texts += [sentence(rng, 20) + " " + item + " " + sentence(rng, 20), sentence(rng, 25) + " " + " ".join(item.split()[1:]), "keep \ufffd this " + sentence(rng, 30)]
    texts += [None, "", "too short", "## ** $$ " * 30, "same words here again and " * 12]
    rows = [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)]
    folder = write_tables(spark, tmp_path, spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(1, item)], "item_id long, text string"))
    left = {i: t for i, t in enumerate(texts) if plain_verdict(t)}
    same = components({i: shingle_set(t, 5) for i, t in left.items()}, 80)
    left = {i: t for i, t in left.items() if same[i] == i}
    left = dict(zip(left, without_repeats(list(left.values())), strict=True))
    left = {i: t for i, t in left.items() if not plain_leaks(t, item)}
    assert 10 < len(left) < len(texts) - 12 and any("\ufffd" in t for t in left.values())
    got = collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(__import__("public_tokenizers").path(packing.VOCABULARY))
    assert set(got) == set(left)
    for i, pieces in got.items():
        n = len(tokenizer.encode(left[i], add_special_tokens=False).ids) + 1
        assert sum(p[1] for p in pieces) == n and {p[2] for p in pieces} == {n}
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts) if plain_verdict(t) and same[i] == i], SCHEMA)
    docs.write.parquet(str(tmp_path / "distinct"))
    cut = stages["suffix_dedup"](spark, spark.read.parquet(str(tmp_path / "distinct")), folder)
    assert {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] in left} == left


def test_pipeline_of_empty_tables(spark, nothing):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_pipeline_keeps_repeated_rows_once(spark, tmp_path):
    """Repeated rows of an id and copies without an id leave one row with its text; other rows of an id stay."""
    import corpus_pipeline

    rng = random.Random(18)
    a, b, c, d = (sentence(rng, 80) for _ in range(4))
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (3, c), (None, c), (5, d), (5, sentence(rng, 80))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(3)
    folder = write_tables(spark, tmp_path, docs)
    stages = dict(corpus_pipeline.STAGES)
    once = stages["near_dedup"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    once.write.parquet(str(tmp_path / "once"))
    once = spark.read.parquet(str(tmp_path / "once"))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in once.collect()) == sorted([(1, a), (0, b), (3, c), (5, d), (5, rows[-1][1])])
    left = stages["suffix_dedup"](spark, once, folder).collect()
    assert sorted(r["text"] for r in left) == sorted([a, b, c, d, rows[-1][1]])
