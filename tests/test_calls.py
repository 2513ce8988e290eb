"""Model calls in rounds with models that fail, model creation with fallbacks, and BERTScore by the token hook."""

import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from tierlink.functions import hooks
from tierlink.operators import metrics
from tierlink.operators.calls import call_model


@pytest.fixture
def hook():
    old = dict(hooks._KINDS)
    yield hooks.register
    hooks._KINDS.clear()
    hooks._KINDS.update(old)


def flaky(folder):
    """Fails on a text until it has been asked as often as its number says; texts with "never" always fail."""
    def model(text):
        mark = Path(folder) / text.replace(" ", "_")
        with mark.open("a") as f:
            f.write("x")
        if "never" in text or mark.stat().st_size < int(text.split()[0]):
            raise ValueError(f"not yet {text}")
        return text.upper()

    return model


def test_calls_in_rounds(spark, tmp_path, hook):
    (tmp_path / "marks").mkdir()
    hook("generate", flaky(tmp_path / "marks"))
    rows = [(i, f"{1 + i % 4} q{i}") for i in range(30)] + [(99, "1 never"), (5, "2 q5")]
    frame = spark.createDataFrame(rows, "id int, prompt string").repartition(3)
    results, failures = call_model(frame, "id", "prompt", f"{tmp_path}/calls", attempts=4)
    got = {r["id"]: r["value"] for r in results.collect()}
    assert results.count() == 30 and got == {i: p.upper() for i, p in rows if i != 99}
    assert max(r["attempt"] for r in results.collect()) > 1
    assert [(r["id"], r["attempts"]) for r in failures.collect()] == [(99, 4)] and "ValueError" in failures.first()["error"]
    before = sum(p.stat().st_size for p in (tmp_path / "marks").iterdir())
    again, _ = call_model(frame, "id", "prompt", f"{tmp_path}/calls", attempts=4)  # whole rounds are there: nothing is called
    assert {r["id"]: r["value"] for r in again.collect()} == got and sum(p.stat().st_size for p in (tmp_path / "marks").iterdir()) == before


def test_a_run_goes_on_behind_its_whole_rounds(spark, tmp_path, hook):
    (tmp_path / "marks").mkdir()
    hook("generate", flaky(tmp_path / "marks"))
    frame = spark.createDataFrame([(1, "1 a"), (2, "9 b")], "id int, prompt string")
    _, failures = call_model(frame, "id", "prompt", f"{tmp_path}/calls", attempts=1)
    assert [r["id"] for r in failures.collect()] == [2]
    results, failures = call_model(frame, "id", "prompt", f"{tmp_path}/calls", attempts=9)
    assert {r["id"] for r in results.collect()} == {1, 2} and failures.count() == 0
    assert (tmp_path / "marks" / "1_a").stat().st_size <= 2  # not called again


def test_no_rows(spark, tmp_path):
    results, failures = call_model(spark.createDataFrame([], "id int, prompt string"), "id", "prompt", f"{tmp_path}/calls")
    assert results.count() == 0 and failures.count() == 0


def test_fallback_settings():
    tried = []

    def make(size):
        tried.append(size)
        if size > 1:
            raise MemoryError(f"{size} is too large")
        return lambda t: f"{t} by {size}"

    model = hooks.with_fallbacks(make, [{"size": 4}, {"size": 4}, {"size": 2}, {"size": 1}])
    assert model(["a", "b"]) == ["a by 1", "b by 1"] and model(["c"]) == ["c by 1"] and tried == [4, 2, 1]
    with pytest.raises(RuntimeError, match="3 is too large"):
        hooks.with_fallbacks(make, [{"size": 3}])(["a"])


def scored(pred, ref, known, weight):
    a, b = (np.array([known[t] for t in x]) for x in (pred, ref))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    s = a @ b.T
    wa, wb = (np.array([weight(t) for t in x]) for x in (pred, ref))
    p, r = (s.max(1) @ wa) / wa.sum(), (s.max(0) @ wb) / wb.sum()
    return p, r, 2 * p * r / (p + r)


@pytest.mark.parametrize("idf", [True, False])
def test_bert_score(spark, hook, idf):
    rng = random.Random(5)
    known = {f"w{i}": [rng.random() for _ in range(6)] for i in range(20)}
    hook("embed_tokens", lambda text: [(t, known[t]) for t in text.split()])
    rows = []
    for i in range(12):
        texts = [" ".join(f"w{rng.randrange(20)}" for _ in range(rng.randrange(1, 9))) for _ in range(4)]
        rows.append((i, texts[0], texts[1 : 1 + rng.randrange(1, 4)]))
    rows += [(50, "", ["w1"]), (51, "w1 w2", ["", " "]), (52, "w1", []), (53, None, ["w1"]), (54, "w3", [None, "w3"])]
    got = {r["id"]: r for r in metrics.bert_score(spark.createDataFrame(rows, "id int, prediction string, references array<string>"), idf).collect()}
    refs = [r.split() for _, p, rs in rows if p and p.strip() for r in rs if r and r.strip()]
    df = Counter(t for r in refs for t in set(r))

    def weight(t):
        return math.log((len(refs) + 1) / (df[t] + 1)) if idf else 1.0

    for i, p, rs in rows:
        each = [scored(p.split(), r.split(), known, weight) for r in rs if p and p.strip() and r and r.strip()]
        want = max(each, key=lambda x: x[2]) if each else (0.0, 0.0, 0.0)
        assert np.allclose([got[i]["precision"], got[i]["recall"], got[i]["f1"]], want), i


def test_token_vectors_stay_in_the_task(spark, hook):
    """The hook sees a few texts at a time and no vector is written; before, a batch of all rows was held and stored."""
    def model(texts):
        assert len(texts) <= metrics.PAIRS
        return [[(w, [1.0, float(len(w))]) for w in t.split()] for t in texts]

    hooks.register("embed_tokens", model, batch=True)
    rows = spark.createDataFrame([(i, "a bb", ["a cc"]) for i in range(500)], "id int, prediction string, references array<string>").coalesce(1)
    assert metrics.bert_score(rows, False).where("f1 > 0.99").count() == 500
    pairs = rows.selectExpr("id", "0 as ref", "prediction", "references[0] as reference")
    assert dict(metrics.token_matches(pairs).dtypes)["p"] == "array<struct<token:string,m:double>>"
