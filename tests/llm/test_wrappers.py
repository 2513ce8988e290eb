"""Wrappers decide what is article: misleading names, long groups, deep containers, merging in a tree."""

import random

import pytest

from tierlink.llm import html_extract as H

WORDS = "ora bel tun kis mar dov len pas rig som".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def inferred(pages):
    """Plain form: all pages of one structure aligned in one loop."""
    wrapper = None
    for i, page in enumerate(pages):
        fields = H.collapse(list(H.blocks(page)), str(i))
        wrapper = fields if wrapper is None else H.merge(wrapper, fields)
    return H.with_main(wrapper)


@pytest.mark.parametrize("story, fixed", [("sidebar", "content"), ("widget", "post-text"), ("x1", "entry"), ("promo", "x2"), ("qa", "qb")])
def test_text_that_varies_is_the_article_whatever_the_names(story, fixed):
    rng = random.Random(3)
    texts = [words(rng, 12) + f" {i}" for i in range(6)]
    box = "All of our readers get our best regards, and there is nothing else to be said on any page of this site in this box"
    pages = [f'<body><nav>n</nav><div class="{fixed}"><p>{box}</p></div><div class="{story}"><p>{t}</p></div><footer>f {i}</footer></body>' for i, t in enumerate(texts)]
    wrapper = inferred(pages)
    assert [H.extract(p, wrapper) for p in pages] == texts
    alone = [H.extract(p, None) for p in pages]  # names alone, or length alone, take the fixed box
    assert all(t != box for t in texts) and alone == [box] * 6


def test_names_decide_between_regions_that_vary():
    rng = random.Random(4)
    texts = [words(rng, 5) for _ in range(5)]
    pages = [f'<body><div class="q"><p>{t}</p></div><div class="comments"><p>{words(rng, 200)}</p></div></body>' for t in texts]
    assert [H.extract(p, inferred(pages)) for p in pages] == texts


def test_fixed_boxes_inside_an_unnamed_region_are_left_out():
    texts = [f"the story of day {i} and what came of it" for i in range(5)]
    pages = [f'<body><nav>n</nav><div class="a7"><p>{t}</p><div class="b9">Read on tomorrow</div></div></body>' for t in texts]
    assert [H.extract(p, inferred(pages)) for p in pages] == texts
    copies = [f'<body><nav>n</nav><div class="a7"><p>told once and for all</p></div><div class="ad">{i}</div></body>' for i in range(5)]
    assert [H.extract(p, inferred(copies)) for p in copies] == ["told once and for all"] * 5


@pytest.mark.parametrize("size", [2, 9, 40])
def test_groups_of_any_size(size):
    def page(n, i):
        return "<main>" + "".join(f'<section class="s{chr(97 + k % 26) * (1 + k // 26)}">{i} {j} {k}</section>' for j in range(n) for k in range(size)) + "</main>"

    wrapper = inferred([page(n, i) for i, n in enumerate((3, 1, 2))])
    assert len(wrapper) == 1 and wrapper[0]["many"] and len(wrapper[0]["group"]) == size
    assert H.extract(page(5, 7), wrapper) == " ".join(f"7 {j} {k}" for j in range(5) for k in range(size))


def test_repeats_equal_a_plain_search():
    rng = random.Random(5)
    for _ in range(200):
        names = [rng.randrange(3) for _ in range(rng.randrange(2, 25))]
        for size in range(2, len(names) // 2 + 1):
            plain = [i for i in range(len(names) - 2 * size + 1) if names[i : i + size] == names[i + size : i + 2 * size]]
            assert H.repeats(H.np.array(names), size).tolist() == plain


def test_containers_below_the_spelled_ones_still_count():
    deep = "<div>" * 300
    page = f'<body>{deep}<article><p>told here</p><div class="ad">buy</div></article><nav>menu</nav><div class="x">else</div></body>'
    paths = {t: p for p, _, t in H.blocks(page)}
    assert len(set(paths.values())) == 4
    assert H.extract(page, None) == "told here"


def test_very_long_page():
    text = "wort " * 400_000
    assert H.extract(f"<body><nav>n</nav><div><p>{text}</p></div></body>", None) == text.strip()


def random_host(rng):
    """(pages, article texts) of one template whose container names say nothing, or the wrong thing."""
    story, box = rng.sample(["content", "sidebar", "x", "y", "share", "post"], 2)
    fixed = words(rng, 4)
    kinds = [rng.choice(["p", "quote", "pair"]) for _ in range(rng.randrange(1, 4))]
    pages, texts = [], []
    for i in range(rng.randrange(4, 9)):
        body, text = [], []
        for kind in kinds:
            for _ in range(rng.randrange(1, 4)):
                a, b = words(rng, rng.randrange(8, 15)) + f" {i}", words(rng, 9)
                body.append({"p": f"<p>{a}</p>", "quote": f"<blockquote>{a}</blockquote>", "pair": f"<figure>{a}</figure><blockquote>{b}</blockquote>"}[kind])
                text += [a, b] if kind == "pair" else [a]
        notice = f'<div class="{box}">{fixed}</div>' if i % 3 or i == 0 else ""
        pages.append(f'<body><header>site</header>{notice}<div class="{story}"><p>lead {i} {words(rng, 60)}</p>{"".join(body)}</div><footer>{i}</footer></body>')
        texts.append(" ".join(["lead " + str(i) + pages[-1].split(f"lead {i}")[1].split("</p>")[0], *text]))
    return pages, texts


def test_tree_of_partial_wrappers_equals_brute_force(spark, monkeypatch):
    """Random templates on many tasks, partial wrappers aligned two at a time: the text that went in, as one loop over all pages finds it."""
    monkeypatch.setattr(H, "FAN_IN", 2)
    rng = random.Random(6)
    rows, want, plain = [], {}, {}
    for h in range(8):
        pages, texts = random_host(rng)
        groups: dict[str, list[str]] = {}
        for p in pages:
            groups.setdefault(H.structure(list(H.blocks(p))), []).append(p)
        found = {k: inferred(v) for k, v in groups.items()}
        for i, (p, t) in enumerate(zip(pages, texts, strict=True)):
            rows.append((h * 100 + i, f"http://h{h}.example/{i}", p, "old", -1))
            want[h * 100 + i] = t
            plain[h * 100 + i] = H.extract(p, found[H.structure(list(H.blocks(p)))])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(9, "page_id")
    got = H.extract_main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]  # clashing columns are replaced
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in got.collect()}
    assert plain == want
    assert got == {k: (t, len(t)) for k, t in want.items()}
