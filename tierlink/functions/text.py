"""Scalar text functions as Column expressions: normalisation, JSON and answer parsing.

Every function maps Columns to a Column inside whole-stage code generation; null gives null unless
a default is stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that the results depend on.
NON_PHRASE = "[^A-Za-z0-9 ]"
NON_ENTITY = "[^0-9a-z]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLE = r"\b(a|an|the)\b"
JSON_DEPTH_3 = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"
ANSWER_MARK = "Answer:"
FINAL_MARK = "Final short answer:"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_phrase(c: Column | str) -> Column:
    """Lower case, other than ASCII letters, digits and spaces to a space, trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), NON_PHRASE, " "))


def normalize_entity(c: Column | str) -> Column:
    """Lower case, runs other than ASCII letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.trim(col(c))), NON_ENTITY, " "))


def alnum_len(c: Column | str) -> Column:
    """Number of ASCII letters and digits."""
    return F.length(F.regexp_replace(col(c), "[^A-Za-z0-9]", ""))


def extract_json(c: Column | str) -> Column:
    """C4: the first braced span of up to three levels if it parses as JSON, else ''."""
    found = F.regexp_extract(col(c), JSON_DEPTH_3, 0)
    return F.when(F.try_parse_json(found).isNotNull(), found).otherwise(F.lit(""))


def first_line(c: Column) -> Column:
    return F.trim(F.split(F.trim(c), "\n")[0])


def answer_from_response(c: Column | str) -> Column:
    """First line after the last ``Answer:``, or of the whole text."""
    return first_line(F.element_at(F.split(col(c), ANSWER_MARK), -1))


def em_answer(predicted: Column | str, response: Column | str) -> Column:
    """The prediction, else all that follows the first ``Answer:`` mark, else the response."""
    whole = col(response)
    after = F.split(whole, ANSWER_MARK)
    given = F.when(F.contains(whole, F.lit("Answer: ")), F.trim(after[1])).otherwise(whole)
    return F.coalesce(F.nullif(col(predicted), F.lit("")), given)


def rouge_answer(predicted: Column | str, response: Column | str) -> Column:
    """The prediction, else the first line after the last final mark, spaces collapsed."""
    whole = col(response)
    last = F.when(F.contains(whole, F.lit(FINAL_MARK)), F.element_at(F.split(whole, FINAL_MARK), -1)).otherwise(F.element_at(F.split(whole, ANSWER_MARK), -1))
    clean = collapse_spaces(col(predicted))
    return F.coalesce(F.nullif(clean, F.lit("")), collapse_spaces(first_line(last)))


def collapse_spaces(c: Column | str) -> Column:
    """C17: white-space runs to one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def fold(c: Column | str) -> Column:
    """C17: trimmed lower case."""
    return F.lower(F.trim(col(c)))


def judge_choice(c: Column | str) -> Column:
    """``"choice": "A|B"`` of a JSON answer, else the first standalone A or B, else ''."""
    up = F.upper(col(c))
    named = F.regexp_extract(up, r'"CHOICE"\s*:\s*"([AB])"', 1)
    alone = F.regexp_extract(up, r"(?:^|[^A-Z0-9_])([AB])(?:[^A-Z0-9_]|$)", 1)
    return F.coalesce(F.nullif(named, F.lit("")), alone)


def answer_letter(c: Column | str) -> Column:
    """Full match of a letter A to E, else the first standalone one, else after ``ANSWER:``, else ''."""
    up = F.upper(F.trim(col(c)))
    full = F.regexp_extract(up, r"^\(?([A-E])\)?[.:]?$", 1)
    alone = F.regexp_extract(up, r"(?:^|[^A-Z0-9_])([A-E])(?:[^A-Z0-9_]|$)", 1)
    marked = F.regexp_extract(up, r"ANSWER:\s*([A-E])", 1)
    return F.coalesce(F.nullif(full, F.lit("")), F.nullif(alone, F.lit("")), marked)


def final_letter(c: Column | str) -> Column:
    """Labelled decision, else the last of the last 8 lines that is a letter, else the last standalone letter."""
    up = F.upper(col(c))
    labelled = [F.regexp_extract(up, p, 1) for p in (r"FINAL DECISION\s*:?\s*\(?([A-E])\)?", r"FINAL ANSWER\s*:?\s*\(?([A-E])\)?", r"ANSWER\s*:\s*\(?([A-E])\)?")]
    lines = F.filter(F.transform(F.split(up, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    tail = F.filter(F.slice(F.reverse(lines), 1, 8), lambda x: x.rlike(r"^\(?[A-E]\)?[.:]?$"))
    by_line = F.regexp_extract(F.coalesce(F.get(tail, F.lit(0)), F.lit("")), "([A-E])", 1)
    all_alone = F.regexp_extract_all(F.regexp_replace(up, "([^A-Z0-9_])", " $1 "), F.lit(r"(?:^|[^A-Z0-9_])([A-E])(?:[^A-Z0-9_]|$)"), F.lit(1))
    alone = F.coalesce(F.try_element_at(all_alone, F.lit(-1)), F.lit(""))
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (*labelled, by_line)], alone)


def index_letter(c: Column | str) -> Column:
    """C11: 0 to 4 as A to E, else ''."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in "ABCDE"]), col(c).cast("int")), F.lit(""))


def normalize_answer(c: Column | str) -> Column:
    """Lower case, ASCII punctuation deleted, articles out, spaces collapsed."""
    bare = F.regexp_replace(F.lower(col(c)), PUNCTUATION, "")
    return collapse_spaces(F.regexp_replace(bare, ARTICLE, " "))


def tokens(c: Column | str) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(col(c), r"\s+"), lambda x: x != "")


def bag_overlap(a: Column, b: Column) -> Column:
    """U4: size of the multiset intersection of two token arrays: both sorted once and merged in one pass."""

    def step(z: Column, s: Column) -> Column:
        x, y = F.get(z["a"], s["i"]), F.get(z["b"], s["j"])
        on = F.struct((s["i"] + (x <= y).cast("int")).alias("i"), (s["j"] + (x >= y).cast("int")).alias("j"), (s["n"] + (x == y).cast("int")).alias("n"))
        return F.when(x.isNull() | y.isNull(), s).otherwise(on)

    zero = F.lit(0)
    start = F.struct(zero.alias("i"), zero.alias("j"), zero.alias("n"))
    both = F.array(F.struct(F.array_sort(a).alias("a"), F.array_sort(b).alias("b")))  # sorted arrays under a name
    steps = F.sequence(F.lit(1), F.greatest(F.size(a) + F.size(b), F.lit(1)))
    return F.get(F.transform(both, lambda z: F.aggregate(steps, start, lambda s, _: step(z, s), lambda s: s["n"])), zero)


def token_f1(pred: Column | str, gold: Column | str) -> Column:
    """struct(f1, precision, recall) of normalised answers; differing yes/no/noanswer give 0."""
    p, g = normalize_answer(pred), normalize_answer(gold)
    pt, gt = tokens(p), tokens(g)
    same = bag_overlap(pt, gt).cast("double")
    special = F.array(F.lit("yes"), F.lit("no"), F.lit("noanswer"))
    clash = (F.array_contains(special, p) | F.array_contains(special, g)) & (p != g)
    zero = F.struct(F.lit(0.0).alias("f1"), F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"))
    precision, recall = same / F.size(pt), same / F.size(gt)
    value = F.struct((2 * precision * recall / (precision + recall)).alias("f1"), precision.alias("precision"), recall.alias("recall"))
    return F.when(clash | (same == 0), zero).otherwise(value)


def exact_match(pred: Column | str, gold: Column | str) -> Column:
    """C14: equality of normalised answers as 0.0 or 1.0."""
    return (normalize_answer(pred) == normalize_answer(gold)).cast("double")


def anchor_weight(c: Column | str) -> Column:
    """1.0 from three tokens, 0.9 for two, 0.6 from ten characters, else 0.25."""
    n = F.size(tokens(c))
    return F.when(n >= 3, 1.0).when(n == 2, 0.9).when(F.length(col(c)) >= 10, 0.6).otherwise(0.25)


def safe_float(c: Column | str, default: float | None = None) -> Column:
    """A finite double, else the default."""
    x = F.try_cast(col(c), "double") if hasattr(F, "try_cast") else col(c).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull(), F.lit(default).cast("double")).otherwise(x)


def nonnegative_int(c: Column | str) -> Column:
    """Truncated number, floored at 0; null if it isn't one."""
    return F.greatest(F.lit(0), safe_float(c).cast("int"))


def unquote(c: Column | str) -> Column:
    """The text without a pair of outer double quotes."""
    x = F.trim(col(c))
    quoted = x.startswith('"') & x.endswith('"') & (F.length(x) >= 2)
    return F.when(quoted, F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)


# Bucket names of subjects.
SUBJECTS = {"natural science": "NAT", "social science": "Soc", "language science": "LAN"}


def subject_bucket(c: Column | str) -> Column:
    """The subject's short name, else ``OTHER``."""
    known = F.create_map(*[F.lit(x) for pair in SUBJECTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, fold(c)), F.lit("OTHER"))


def modality_bucket(image: Column | str, hint: Column | str) -> Column:
    """``IMG`` with an image, ``TXT`` with a hint, else ``NO``."""
    has_image = ~F.trim(F.coalesce(col(image), F.lit(""))).isin("", "null", "None")
    return F.when(has_image, "IMG").when(F.trim(F.coalesce(col(hint), F.lit(""))) != "", "TXT").otherwise("NO")


def grade_bucket(c: Column | str) -> Column:
    """``gradeN`` as ``G1-6`` up to 6 and ``G7-12`` beyond, else ``UNKNOWN``."""
    n = F.trim(F.replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), F.lit("grade"), F.lit(""))).try_cast("int")
    return F.when(n <= 6, "G1-6").when(n > 6, "G7-12").otherwise("UNKNOWN")


def model_label(c: Column | str, allowed: str = "025") -> Column:
    """C20: the exact label, else the first allowed character; an error otherwise."""
    x = F.trim(col(c))
    first = F.regexp_extract(x, f"[{allowed}]", 0)
    return F.when(first != "", first).otherwise(F.raise_error(F.concat(F.lit("no label in: "), x)))


def valid_triple(items: Column | str) -> Column:
    """Three trimmed non-empty strings, else null."""
    t = F.transform(col(items), lambda x: F.trim(x))
    return F.when((F.size(t) == 3) & F.forall(t, lambda x: x != ""), t)


def triples_from_text(c: Column | str) -> Column:
    """``(a, b, c)`` triples of a response as arrays; those with UNKNOWN are target triples."""
    parts = F.regexp_extract_all(col(c), F.lit(r"\(([^(),]+,[^(),]+,[^(),]+)\)"), F.lit(1))
    return F.filter(F.transform(parts, lambda x: valid_triple(F.split(x, ","))), lambda t: t.isNotNull())


def is_wildcard(c: Column | str) -> Column:
    """whether a pattern name holds UNKNOWN (case matters)."""
    return F.contains(col(c), F.lit("UNKNOWN"))


def fingerprint(*parts: Column | str) -> Column:
    """MD5 of the parts joined by ``|``."""
    return F.md5(F.concat_ws("|", *parts))


def safe_file_name(c: Column | str) -> Column:
    """Other than letters, digits, dot, dash and underscore to an underscore."""
    return F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_")


def entity_list(c: Column | str) -> Column:
    """Normalised ``named_entities`` of a JSON answer; empty if it doesn't parse."""
    parsed = F.from_json(extract_json(c), "named_entities array<string>")["named_entities"]
    return F.transform(F.coalesce(parsed, F.array().cast("array<string>")), normalize_phrase)


def sorted_distinct(c: Column | str) -> Column:
    """Sorted distinct items of a nested list."""
    return F.array_sort(F.array_distinct(F.flatten(col(c))))


def clean_list(c: Column | str) -> Column:
    """Trimmed non-empty items, the first of equals."""
    return F.array_distinct(F.filter(F.transform(col(c), lambda x: F.trim(x)), lambda x: x != ""))


def to_bool(c: Column | str) -> Column:
    """true, 1, yes or y in any case."""
    return F.coalesce(fold(c).isin("true", "1", "yes", "y"), F.lit(False))


def lookup_keys(raw: Column | str, canonical: Column | str) -> Column:
    """Distinct non-null keys: raw, normalised and canonical."""
    return F.array_distinct(F.array_compact(F.array(col(raw), normalize_entity(raw), col(canonical))))
