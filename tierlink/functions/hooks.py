"""Extension points for external models, with deterministic stand-ins that need no network.

X1 entity recognition, X2 triple extraction, X7 text embedding and X8 generation are pandas UDFs
over batches; real models replace the stand-ins by ``register``, as functions of one text or of a
whole batch. X3-X6 and X9-X11 (linkers, extractors, matchers, rankers, losses, evaluators,
constructors) are DataFrame functions, named in ``tierlink.plans.components``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 64
NAME = re.compile(r"\b[A-Z][\w-]+(?: [A-Z][\w-]+)*")
FACT = re.compile(r"\b([A-Z][\w-]+(?: [A-Z][\w-]+)*) (is [\w ]{1,30}? of|[a-z]{3,12}s) ([A-Z][\w-]+(?: [A-Z][\w-]+)*)")


def names_in(text: str) -> list[str]:
    """Runs of capitalised words, each once."""
    return list(dict.fromkeys(NAME.findall(text or "")))


def facts_in(text: str) -> list[list[str]]:
    """``Name verb Name`` facts."""
    return [list(m) for m in FACT.findall(text or "")]


def vector_of(text: str) -> list[float]:
    """Signed hashing of words, length 1."""
    v = np.zeros(DIMENSIONS)
    for w in (text or "").lower().split():
        h = hashlib.md5(w.encode()).digest()
        v[h[0] % DIMENSIONS] += 1 if h[1] & 1 else -1
    return (v / max(np.linalg.norm(v), 1e-12)).astype(float).tolist()


def token_vectors_of(text: str) -> list[tuple[str, list[float]]]:
    """Each lower-case word with its vector."""
    return [(w, vector_of(w)) for w in (text or "").lower().split()]


def reply_to(prompt: str) -> str:
    """The last line of the prompt as the answer."""
    lines = (prompt or "").strip().split("\n")
    return f"Answer: {lines[-1]}"


def each(one: Callable) -> Callable:
    """A function of a batch from a function of one text."""
    return lambda texts: [one(t) for t in texts]


_KINDS: dict[str, tuple[Callable, T.DataType]] = {
    "ner": (each(names_in), T.ArrayType(T.StringType())),
    "openie": (each(facts_in), T.ArrayType(T.ArrayType(T.StringType()))),
    "embed": (each(vector_of), T.ArrayType(T.DoubleType())),
    "embed_tokens": (each(token_vectors_of), T.ArrayType(T.StructType().add("token", T.StringType()).add("v", T.ArrayType(T.DoubleType())))),
    "generate": (each(reply_to), T.StringType()),
}


def register(kind: str, model: Callable, batch: bool = False) -> None:
    """Replace a stand-in by a function of one text, or with ``batch`` of a list of texts that returns as many results."""
    if kind not in _KINDS:
        raise KeyError(f"no hook {kind!r}; there are {sorted(_KINDS)}")
    _KINDS[kind] = (model if batch else each(model), _KINDS[kind][1])


def model_of(kind: str) -> Callable:
    """The hook as a function of a list of texts, for tasks that don't keep all it returns."""
    return _KINDS[kind][0]


def apply(kind: str, text: Column | str) -> Column:
    """The hook as a column: an iterator pandas UDF, so a model is set up once for many batches."""
    model, returned = _KINDS[kind]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(model(batch.tolist())), index=batch.index, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returned)(F.col(text) if isinstance(text, str) else text)


def attempt(kind: str, text: Column | str) -> Column:
    """The hook as a column of (value, error): a text that it fails on has the error's words and no value.

    A batch that fails as a whole is tried text by text, so one bad text spoils no other.
    """
    model, returned = _KINDS[kind]

    def one(text: str) -> tuple:
        try:
            return next(iter(model([text]))), None
        except Exception as e:  # whatever a model raises is a result here, told by the caller's failure table
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            try:
                out = [(v, None) for v in model(texts)]
            except Exception:
                out = [one(t) for t in texts]
            yield pd.DataFrame({"value": pd.Series([v for v, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = T.StructType().add("value", returned).add("error", T.StringType())
    return F.pandas_udf(run, found)(F.col(text) if isinstance(text, str) else text)


def with_fallbacks(make: Callable, settings: list[dict]) -> Callable:
    """A batch function that makes its model where it runs, once a process, by the first of ``settings`` that works.

    Equal settings are tried once; if none works, the error tells why each failed.
    """
    kept: list = []
    once = [s for i, s in enumerate(settings) if s not in settings[:i]]

    def run(texts: list) -> list:
        if not kept:
            errors = []
            for s in once:
                try:
                    kept.append(make(**s))
                    break
                except Exception as e:
                    errors.append(f"{s}: {e}")
            else:
                raise RuntimeError("no setting works: " + "; ".join(errors))
        return [kept[0](t) for t in texts]

    return run
