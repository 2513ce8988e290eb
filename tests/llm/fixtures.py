"""Awkward tables for every operator: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

WORDS = "the and of to in harbor lantern meadow quartz violin ember saddle timber velvet walnut cobalt drift fable glacier hollow ivory jungle kettle linen marble nectar orchid pebble quiver raven".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_rows(seed=1):
    """(doc_id, text, lang, source, n_chars) with copies, near copies, shared passages and odd cases."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randrange(30, 90)) for _ in range(12)]
    passage = sentence(rng, 60)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20 + i, base[0]) for i in range(4)]  # exact copies
    for i in range(8):  # near copies
        w = base[1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((30 + i, " ".join(w)))
    rows += [(40 + i, sentence(rng, 15) + " " + passage + " " + sentence(rng, 20)) for i in range(4)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "One two"), (55, "ünï cödé ßtraße 漢字 é"), (56, "a" * 5000), (57, sentence(rng, 6000)), (None, base[2]), (None, None)]
    rows += [(2, base[2]), (2, base[2])]  # repeated rows
    return [(i, t, "en" if i is None or i % 3 else "de", None if i == 41 else f"s{(i or 0) % 3}", len(t) if t is not None else None) for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark, seed=1):
    return spark.createDataFrame(awkward_rows(seed), SCHEMA)


def write_tables(spark, folder, docs=None, benchmark=None, labels=None, pages=None, conversations=None):
    """Parquet tables of one query directory; what isn't given is empty."""
    docs = docs if docs is not None else spark.createDataFrame([], SCHEMA)
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    (benchmark if benchmark is not None else spark.createDataFrame([], "item_id long, text string")).write.parquet(f"{folder}/benchmark.parquet")
    (labels if labels is not None else spark.createDataFrame([], "doc_id long, quality int, toxic int")).write.parquet(f"{folder}/labels.parquet")
    (pages if pages is not None else spark.createDataFrame([], "page_id long, url string, html string")).write.parquet(f"{folder}/pages.parquet")
    (conversations if conversations is not None else spark.createDataFrame([], "conv_id long, turn long, role string, text string")).write.parquet(f"{folder}/conversations.parquet")
    return str(folder)
