"""Pattern packing, filter interactions and the prefix trie against brute force and exact round trips."""

import hashlib
import itertools
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SCHEMA, awkward, awkward_rows, sentence, write_tables  # noqa: E402

from tierlink.llm import decontaminate, filter_audit, pattern_packing, prefix_trie  # noqa: E402

ODD = ["", "<|endoftext|> in a text <|endoftext|>", "it's we'll  two  spaces\n\n\ttabs \r\n", "ünï cödé 漢字 🙂🙂  x y", "a" * 3000, "1234567 12.5e-7", "\x00\x01 \x7f", "'Tis 'S 'LL ''", " lead", "trail  "]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(pattern_packing.VOCABULARY)))


def test_fast_encoder_equals_tokenizer(tokenizer):
    rng = random.Random(2)
    made = ["".join(chr(rng.choice((32, 10, 39, 65, 97, 115, 48, 0xE9, 0x4E2D, 0x1F600, 0x300, 0x85))) for _ in range(60)) for _ in range(300)]
    fast = pattern_packing.encoder(pattern_packing.VOCABULARY)
    assert fast._fast is not None
    for t in ODD + made:
        assert fast.ids(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_other_vocabulary_runs_as_it_is():
    import public_tokenizers
    from tokenizers import Tokenizer

    other = pattern_packing.encoder("word_bpe_49k.json")
    slow = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    assert other._fast is None and other.ids("One two").tolist() == slow.encode("One two", add_special_tokens=False).ids


@pytest.mark.parametrize("window", [16, 1024])
def test_pattern_packing_round_trip(spark, tokenizer, window):
    rng = random.Random(4)
    rows = [(i, t) for i, t, *_ in awkward_rows()] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, sentence(rng, rng.randrange(1, 400))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("mine"), "ids": F.lit(1), "__text": F.lit(2)})
    got = pattern_packing.pack_patterns(docs.repartition(3), window=window, block_bytes=4000).collect()
    want = Counter((i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows)
    whole = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["length"] <= window and (r["length"] == window or r["piece"] == 0)
        whole[r["doc_id"]].append(r)
    # repeated ids: their pieces together hold the same ids as their documents
    for i, pieces in whole.items():
        docs_of = [ids for (k, ids), n in want.items() if k == i for _ in range(n)]
        if len(docs_of) == 1:
            pieces.sort(key=lambda r: r["start"])
            assert [r["piece"] for r in pieces] == list(range(len(pieces))) and pieces[0]["start"] == 0
            assert b"".join(bytes(r["ids"]) for r in pieces) == docs_of[0] and all(r["doc_tokens"] == len(docs_of[0]) // 4 for r in pieces)
        else:
            assert sorted(Counter(bytes(r["ids"]) for r in pieces).items()) == sorted(Counter(d[max(0, j) : j + 4 * window] for d in docs_of for j in cuts(len(d) // 4, window)).items())
    at = defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in at.values():
        places.sort()
        assert [p for p, _ in places] == [0, *itertools.accumulate(n for _, n in places)][:-1] and sum(n for _, n in places) <= window
    lengths = Counter(r["length"] for r in got)
    left = np.zeros(window + 1, np.int64)
    for v, n in lengths.items():
        left[v] = n
    assert len(at) <= 1.02 * sum(k for _, k in pattern_packing.best_fit(left, window)) + 1


def cuts(n, window):
    head = n % window or window
    return [0, *range(4 * head, 4 * n, 4 * window)] if head == window else [-(4 * (window - head)), *range(4 * head, 4 * n, 4 * window)]


def test_plan_places_every_piece():
    rng = random.Random(6)
    for window, n in ((8, 0), (8, 30), (64, 5000), (1024, 20000)):
        lengths = Counter(min(window, 1 + int(rng.expovariate(3 / window))) for _ in range(n))
        plan = pattern_packing.plan_sequences(dict(lengths), window)
        placed = Counter()
        for held, k in plan:
            assert sum(held) <= window and k > 0
            for v in held:
                placed[v] += k
        assert placed == lengths
        total = sum(v * k for v, k in lengths.items())
        if n >= 5000:  # the fit leaves next to nothing over
            assert sum(k for _, k in plan) <= 1.01 * math.ceil(total / window)


def test_least_squares_equals_projected_gradient():
    rng = np.random.default_rng(1)
    columns = pattern_packing.patterns(np.arange(1, 13), 12)
    assert (columns.sum(1) == 12).all() and len({tuple(c) for c in columns}) == len(columns)
    target = np.concatenate([[0], rng.integers(0, 40, 12)]).astype(float)
    x = pattern_packing.least_squares(columns, target)
    a = np.zeros((13, len(columns)))
    for j in range(3):
        np.add.at(a, (columns[:, j], np.arange(len(columns))), 1.0)
    a[0] = 0
    y, step = np.zeros(len(columns)), 1 / np.linalg.norm(a, 2) ** 2
    for _ in range(20000):
        y = np.maximum(y - step * a.T @ (a @ y - target), 0)
    assert (x >= 0).all() and np.linalg.norm(a @ x - target) <= np.linalg.norm(a @ y - target) + 0.01 * np.abs(target).sum()


def audit(rows, labels):
    """The contract, document by document."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in range(2))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    fails = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = word.findall(t)
        f = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]]
        fails.append((lang or "", dict(zip("ABCDE", f, strict=True)), i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in fails}:
        mine = [x for x in fails if x[0] == part]
        for order in itertools.permutations("ABCDE"):
            live = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in live if x[1][c]]
                live = [x for x in live if not x[1][c]]
                out[part, "".join(order), step] = [len(live), len(gone), sum(x[1][c] for x in mine) - len(gone), sum(x[1][c] and sum(x[1].values()) == 1 for x in mine), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                shapley[part, c] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_filter_audit_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [*awkward_rows(), (70, "", None, None, 0), (None, "", "", None, 0), (None, "", "", None, 0), (-3, "", "", None, 0), (71, None, "xx", None, None)]
    pool = [" ".join(rng.choice(("A", "B#", "cc", "dd|", "Ee", sentence(rng, 3))) for _ in range(rng.choice((5, 90, 99, 100, 130)))) for _ in range(30)]
    rows += [(rng.randrange(100, 180), rng.choice(pool), rng.choice(("en", "de", None)), "s", 1) for _ in range(150)]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 180) for _ in range(rng.randrange(3))] + [(None, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"mask": F.lit(1), "good": F.lit("x")}).repartition(4)
    folder = write_tables(spark, tmp_path / "t", docs, labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COLUMNS) for r in filter_audit.op12_query(spark, folder).collect()}
    assert got == audit(rows, labels)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables here")
def test_filter_audit_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = {tuple(r[:3]): tuple(r[3:]) for r in c.sql(f"select part, filter_order, step, {', '.join(COLUMNS)} from ({filter_audit.OP12_SQL})").fetchall()}
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[x] for x in COLUMNS) for r in filter_audit.op12_query(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), r or "", hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()[:16], x or ""))
    own = {c: [(r, x) for _, r, _, x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members, children = defaultdict(list), defaultdict(list)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    for s in members:
        if s:
            children[s[:-1]].append(s)
    out, leaves, saved = {}, {}, {}
    for s in sorted(members, key=len, reverse=True):
        m = members[s]
        leaves[s] = sum(leaves[k] for k in children[s]) if children[s] else 1
        saved[s] = sum(saved[k] for k in children[s]) + ((len(m) - 1) * len(s[-1][1]) if s else 0)
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(s))))
        out[min(m), len(s)] = (min(members[s[:-1]]) if s else None, len(m), len(children[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest())
    return out


def talks(seed, n=140):
    """Conversations of few different turns, so that prefixes are shared to any depth; copies, prefixes of others, null turns, roles and texts."""
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -5, -130, 203, 300, 300]:
        if c == 100:
            continue
        k = rng.choice([0, 1, 2, 3, 5, 8, 13, 30])
        texts = ["a", "b"] * (k // 2) if c % 3 == 0 else [rng.choice("ab") for _ in range(k)]
        rows += [(c, t if rng.random() < 0.97 else None, None if rng.random() < 0.03 else "user", x * (1 + t % 3) if rng.random() < 0.97 else None) for t, x in enumerate(texts)]
    return [*rows, (None, 1, "user", "x"), (7, 0, "user", "a"), (7, 0, "user", "a")]


@pytest.mark.parametrize(("block_turns", "elements"), [(256, 1 << 16), (2, 7), (3, 40)])
def test_prefix_trie_equals_brute_force(spark, block_turns, elements):
    """Small blocks of turns make names of names, small blocks of positions make intervals cross them twice over."""
    rows = talks(block_turns)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"p": F.lit(1), "key": F.lit("x"), "depth": F.lit(2)})
    got = prefix_trie.prefix_trie(frame.repartition(5), block_turns, elements).collect()
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert len(got) == len({(r["conv_id"], r["depth"]) for r in got})
    assert {(r["conv_id"], r["depth"]): tuple(r[x] for x in names) for r in got} == trie(rows)


def test_prefix_trie_of_copies(spark, monkeypatch):
    """Ids that end at a node pass in chunks; all conversations are one, or none has a turn of its own."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = [(c, t, "user", "x" * (t + 1)) for c in range(1000, 1040) for t in range(6)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    got = prefix_trie.prefix_trie(frame, 4, 8).collect()
    assert {(r["conv_id"], r["depth"]): tuple(r[x] for x in names) for r in got} == trie(rows)


@pytest.mark.parametrize("seed", range(3))
def test_nearest_smaller_values_in_blocks(seed):
    """Cutting the positions in blocks changes no node."""
    rng = random.Random(seed)
    n = 200
    size = [rng.randrange(0, 9) for _ in range(n)]
    lcp = [-1, *[min(size[i - 1], size[i], rng.randrange(0, 9)) for i in range(1, n)]]
    rows = {"i": range(n), "c": [i * 7 % 1009 for i in range(n)], "n": size, "v": lcp, "k": [rng.randrange(50) for _ in range(n)]}
    whole = pa.table({k: pa.array(list(v), pa.int64()) for k, v in rows.items()})

    def nodes(t):
        keep = [x for x in t.to_pylist() if x["kind"] == prefix_trie.NODE]
        return sorted((x["l"], x["r"], x["lo"], x["hi"], x["least"], x["children"], x["leaves"], x["k"], x["first_n"]) for x in keep)

    want = nodes(prefix_trie.reduced(whole, n))
    parts = [prefix_trie.reduced(whole.slice(i, 9), None) for i in range(0, n, 9)]
    found = [x for p in parts for x in nodes(p)]
    rest = pa.concat_tables([p.filter(pa.compute.equal(p.column("kind"), prefix_trie.OPEN)) for p in parts])
    assert sorted(found + nodes(prefix_trie.reduced(rest, n))) == want


def test_numbered_runs_cross_partitions(spark):
    rows = [(k, j, k + j) for k, n in enumerate((1, 300, 2, 0, 50)) for j in range(n)]
    frame = spark.createDataFrame(rows, "k long, j long, w long").repartition(7)
    got = {(r["k"], r["j"]): (r["i"], r["first"], r["before"]) for r in prefix_trie.numbered(frame, ["k", "j"], ["k"], "w").collect()}
    want, first, total = {}, {}, Counter()
    for i, (k, j, w) in enumerate(sorted(rows)):
        first.setdefault(k, i)
        want[k, j] = (i, first[k], total[k])
        total[k] += w
    assert got == want


def test_awkward_documents_pack_alike_in_any_order(spark):
    """The number of sequences follows from the lengths alone."""
    docs = awkward(spark).select("doc_id", "text")
    a, b = (pattern_packing.pack_patterns(d).select("sequence_id").distinct().count() for d in (docs.coalesce(1), docs.repartition(4, "text")))
    assert a == b


@pytest.mark.parametrize(("free_ends", "sizes"), [(False, (24, 100, 500)), (False, (800, 1500)), (True, (24, 100, 500)), (True, (800, 1500)), (True, (5000,))])
def test_long_items_are_found_at_the_limit(spark, free_ends, sizes):
    """Items of 24 to 5,000 words after edits of one fifth: each kind is found, also where no plan reaches the recall."""
    rng = np.random.default_rng(12)
    docs, items, want = [], [], set()
    for n in sizes:
        for kind in ("replace", "insert", "delete", "all") if n < 5000 else ("insert", "delete"):
            item = rng.integers(1, 1 << 62, n).tolist()
            changed = list(item)  # windows of n words lose at their end what is put in
            for k in sorted(rng.choice(n, int((0.2 if free_ends or kind == "replace" else 0.08) * n), replace=False).tolist(), reverse=True):
                new, how = int(rng.integers(1, 1 << 62)), kind if kind != "all" else ("replace", "insert", "delete")[k % 3]
                changed[k : k + 1] = {"replace": [new], "insert": [changed[k], new], "delete": []}[how]
            around = rng.integers(1, 1 << 62, 40 + n // 5).tolist()
            docs.append((len(docs), " ".join(map(str, [*around, *changed, *around]))))
            items.append((len(items), " ".join(map(str, item))))
            want.add((docs[-1][0], items[-1][0]))
    docs += [(len(docs), " ".join(map(str, rng.integers(1, 1 << 62, 6000).tolist()))), (len(docs) + 1, None)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), free_ends=free_ends)
    assert {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["leaks"]} == want


def test_plans_end_where_none_reaches_the_recall():
    assert decontaminate.plan_for(5000, 0.2, 0.999, 1) is None and decontaminate.plan_for(60, 0.2, 1.0) is None
    assert decontaminate.plan_for(60, 0.2, 0.999, 1) is not None
