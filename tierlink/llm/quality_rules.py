"""Quality rules as a short-circuit cascade, in DataFrame functions alone.

Base counts come out for every document. The verdict is a cascade: each rule's rejection share is
measured on a sample, and so is its cost: the least time of a few runs over the stored sample, less
that of a run without a rule, in steps of powers of four, so that noise changes the order of rules
of about equal worth at most; rules run in falling rejection per cost, and one CASE expression stops
at the first that rejects. The order changes which rule is named (so ``rejected_by`` may differ from
run to run where several reject) and how much work is done, never which documents are kept.

Defined cases: a null text has no words: it fails ``n_words < 10`` as an empty text does; repeated
rows get equal results; rules of equal rejection per cost run in order of their names; an empty table
gives an empty result; an input column named as a result is replaced, others pass through; very long
texts are counted whole, in memory that grows with one text only.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierlink.llm._columns import without
from tierlink.session import materialize

WORD_GAP = "[\\x20\\x09-\\x0D]+"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
BASE_FAILED = f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
SAMPLE_ROWS = 2000  # expected number of documents that the order of the rules is estimated on
RUNS = 3  # timed runs of a rule over the sample; the least counts
LEAST_SECONDS = 0.02  # a shorter time can't be told from a job's own
#: Result columns; input columns of these names are replaced.
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


@dataclass(frozen=True)
class Rule:
    """A rejecting condition."""

    name: str
    reject: str  # SQL over __t (text), __w (words), __n_lines and the base counts


RULES = (
    Rule("symbols", "100 * n_symbols > 8 * word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * __n_lines"),
    Rule("capitals", "size(filter(__w, x -> x rlike '[A-Z][^A-Z]*[A-Z]' and not x rlike '[a-z]')) * 2 > n_words"),
    Rule("stutter", "10 * size(filter(__w, (x, i) -> x = get(__w, i + 1))) > 3 * n_words"),
    Rule("shouting", "10 * (length(__t) - length(replace(__t, '!!', ''))) > 3 * word_chars"),
)


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``value``, computed once and never put in a row, under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def base_columns(docs: DataFrame, text: str) -> DataFrame:
    """Adds __t, __w, __n_lines and the contract's counts.

    A document's windows are hashed, and only if two hashes are equal sorted with their places; the
    arrays live within one expression, so a row carries no more than its words.
    """
    words = f"filter(split(__t, '{WORD_GAP.replace(chr(92), chr(92) * 2)}'), x -> x <> '')"
    lines = let("filter(split(__t, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')", "l", "struct(size(l) as n, size(l) - size(array_distinct(l)) as dup)")
    gets = ", ".join(f"get(h, i + {j})" for j in range(WINDOW))
    windows = let("transform(__w, x -> xxhash64(x))", "h", f"transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({gets}))")
    twice = "if(get(s, k - 1).h = x.h or get(s, k + 1).h = x.h, x.i, null)"
    places = let("sort_array(transform(g, (x, i) -> struct(x as h, i as i)))", "s", f"sort_array(filter(transform(s, (x, k) -> {twice}), x -> x is not null))")
    covered = let(places, "p", f"aggregate(transform(p, (x, k) -> least({WINDOW}, coalesce(get(p, k + 1) - x, {WINDOW}))), 0, (a, x) -> a + x)")
    repeats = f"if(size(__w) >= {WINDOW}, {let(windows, 'g', f'if(size(array_distinct(g)) < size(g), {covered}, 0)')}, 0)"
    docs = docs.withColumn("__t", F.coalesce(F.col(text), F.lit(""))).withColumn("__w", F.expr(words))
    docs = docs.withColumns(
        {
            "__l": F.expr(lines),
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.expr("regexp_count(__t, '[#*$%&|<>]')").cast("long"),
            "n_repeat_words": F.expr(repeats).cast("long"),
        }
    )
    return docs.withColumns({"n_dup_lines": F.col("__l.dup").cast("long"), "__n_lines": F.col("__l.n")}).drop("__l")


def rejects(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.reject), F.lit(False)).cast("double")


def rule_seconds(stored: DataFrame, rules: tuple[Rule, ...] = RULES) -> dict[str, float]:
    """Seconds of each rule over a stored sample, beyond a run that reads the same columns and no more."""
    read = F.sum(F.length("__t") + F.size("__w") + F.coalesce(F.col("__n_lines"), F.lit(0)))

    def least(*more: Column) -> float:
        times = []
        for _ in range(RUNS):
            begun = time.perf_counter()
            stored.agg(read, *more).first()
            times.append(time.perf_counter() - begun)
        return min(times)

    least()  # the first run also compiles
    alone = least()
    return {r.name: max(LEAST_SECONDS, least(F.avg(rejects(r))) - alone) for r in rules}


def step(seconds: float) -> float:
    """Seconds as a power of four."""
    return 4.0 ** round(math.log(seconds, 4))


def order_rules(stored: DataFrame, rules: tuple[Rule, ...] = RULES, seconds: dict[str, float] | None = None) -> list[Rule]:
    """Rules by rejection per cost over a stored sample with base counts; costs are measured unless given."""
    seconds = rule_seconds(stored, rules) if seconds is None else seconds
    row = stored.agg(*[F.avg(rejects(r)).alias(r.name) for r in rules]).first()
    value = {r.name: (row[r.name] or 0.0) / step(seconds[r.name]) for r in rules}
    return sorted(rules, key=lambda r: (-value[r.name], r.name))


def work_saved(stored: DataFrame, ordered: list[Rule], seconds: dict[str, float]) -> float:
    """Share of the rules' seconds on the sample that stopping at the first rejection saves in this order; base failures run no rule."""
    gone, spent = F.expr(BASE_FAILED), []
    for r in ordered:
        spent.append(F.avg((~gone).cast("double")).alias(r.name))
        gone = gone | (rejects(r) > 0)
    row = stored.agg(*spent).first()
    return 1 - sum((row[r.name] or 0.0) * seconds[r.name] for r in ordered) / sum(seconds[r.name] for r in ordered)


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` plus the base counts, ``base_failed``, ``kept`` and ``rejected_by`` (null if kept)."""
    docs = without(docs, RESULT)
    counted = base_columns(docs, text)
    share = min(1.0, sample_rows / max(1, docs.count()))
    ordered = order_rules(materialize(base_columns(docs.select(text).sample(fraction=share, seed=1), text)), rules)
    failed = F.expr(BASE_FAILED)
    verdict: Column = F.when(failed, F.lit("base"))
    for rule in ordered:
        verdict = verdict.when(F.expr(rule.reject), F.lit(rule.name))
    # a filter on the verdict must not be pushed below the counts: inlined there, they would be computed
    # again at each of their uses; an expression that isn't deterministic keeps it above
    out = counted.withColumns({"base_failed": failed, "rejected_by": verdict, "__row": F.monotonically_increasing_id()})
    return out.withColumn("kept", F.col("rejected_by").isNull() & (F.col("__row") >= 0)).drop("__row", "__t", "__w", "__n_lines")


def op8_query(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``quality_rules`` over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w)::BIGINT - 4)) AS i, w FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(w, i, i + 4)) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, (SELECT unnest([0, 1, 2, 3, 4]) AS k) WHERE n > 1 GROUP BY doc_id),
c AS (SELECT d.doc_id, t, w, l, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 8 * word_chars OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 100 * n_dup_lines > 40 * len(l)
            OR len(list_filter(w, lambda x: regexp_matches(x, '[A-Z][^A-Z]*[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) * 2 > n_words
            OR 10 * len(list_filter(w, lambda x, i: x = w[i + 1])) > 3 * n_words
            OR 10 * (length(t) - length(replace(t, '!!', ''))) > 3 * word_chars) AS kept FROM b
"""
