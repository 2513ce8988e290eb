"""Main text of web pages by union-free wrapper inference.

A page is a stream of tokens: each block of text with the containers that are open around it.
A wrapper of a host is a union-free regular expression over such tokens: a sequence of fields and of
groups of fields, each of which may be optional (``?``) or repeated (``+``); a field holds a literal
or a text slot. It is inferred by aligning the token streams of pages one after another: runs of one
token become repeated fields, sequences of tokens that follow themselves become repeated groups,
tokens that only one side has become optional, and texts that differ become slots. Then the wrapper
says which fields are main text: those of the region that holds the article. Regions are weighed by
the text their fields hold outside links: text that stays the same over three pages or more is the
template's and weighs next to nothing, so a box of fixed words is not the article, whatever it is
called, and a box whose text varies from page to page can be, even if it is called a sidebar. Names
and HTML elements multiply that weight (``NAMED``) and so decide between regions that vary alike. All of
the region is main but for what is marked up or named as navigation, forms, adverts and the like
inside it; in a region that nothing names as content, fields that stay the same are left out too. A
page is then matched with its wrapper, literals with equal text only, and the texts that main fields
take are its main text. Where groups can be read in more than one way and the page's reading isn't
the wrapper's, each field of the page goes by the wrapper's field of the same container and text.

A host may have many templates, so it has a wrapper for each structure of its pages: the outermost
containers of the best content rank a page has, or all containers that may hold main text if none
is named as content. Every page takes part: a task aligns its pages of a structure to one partial
wrapper, and the partial wrappers of a structure, one a task or few, are aligned in a tree that takes
the wrappers of ``FAN_IN`` tasks at a time. So neither a hot host's pages nor its partial wrappers are
ever gathered in one task. Wrappers are broadcast if they measure little, else joined to
pages by host and structure, a join whose skew AQE can split.

Defined cases: a null or empty html gives an empty text; pages without a host (null or odd url)
share wrappers as if of one host; a page with a container that its wrapper lacks gets one of its own; copies of a
page count once towards texts that stay the same; repeated rows give equal rows; an empty table gives
an empty result; ties between regions go to the shorter, then the later path; an input column named
``text`` or ``n_chars`` is replaced, other columns pass through; pages are read whole in linear time,
broken markup included: a tag that the page's end leaves open is text, and after one with an open quote
quotes no longer hide the end of a tag.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierlink.session import broadcast_if_small

CONSTANT = 3  # distinct pages a text must stay the same on to be the template's
FIXED = 1 / 16384  # weight of a character of such text: so little that a box named as content loses to a varying one named otherwise
NAMED = {2: 256, 1: 4, 0: 1, -1: 1 / 1024}  # weight of a region by its content rank; -1: named as no main text
FAN_IN = 256  # tasks whose partial wrappers one task aligns
HELD_CHARS = 16 << 20  # partial wrappers a task holds before it hands them on
DEEP = 256  # containers of a path that are spelled out; those nested deeper stand in it as one digest
TAG = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
# Element kinds of HTML.
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "title", "noembed", "noframes", "xmp"}
HIDDEN = {"svg", "math", "object", "canvas"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINER = set("html head body main article section div nav header footer aside form ul ol dl table menu dialog details figure fieldset blockquote button select".split())
NOT_MAIN = set("head nav header footer aside form menu dialog button select fieldset".split())
NOT_MAIN_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu header masthead footer sidebar sidenav aside widget "
    "cookie cookies consent gdpr notice notices alert popup modal overlay subscribe subscription newsletter signup login search share sharing social related recommended "
    "recommendations trending breadcrumb breadcrumbs pagination pager toolbar comment comments commentlist respond replies reply discussion disqus copyright legal disclaimer skip toc".split()
)
# Words that say nothing of a container's content beside those above.
PLAIN_WORDS = set("area bar block box button buttons container content articles stories entries form group holder icon icons inner item items left link links list main outer panel posts right row section slot stories text title top bottom unit wrap wrapper policy this us the to".split())
MAIN_WORDS = set("article content main post entry story body text maincontent articlebody postbody entrycontent articlecontent".split())
LETTERS = str.maketrans("0123456789abcdef", "bcdfghjklmnpqrst")  # digests without digits and vowels spell none of these words
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def names_of(attributes: str) -> tuple[str, ...]:
    """Class, id and role names of a start tag, digits left out; ``hidden`` if it isn't shown."""
    out = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            out += [x for x in re.sub(r"\d+", "", value).split() if x]
        elif key == "hidden" or value.lower() == "true":
            out.append("hidden")
    return tuple(out)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order: text as it stands, ``data`` (CDATA), start and end tags."""
    i, n, quotes = 0, len(page), True
    while i < n:
        j = page.find("<", i)
        if j < 0:
            j = n
        if j > i:
            yield "text", page[i:j], ""
        if j == n:
            return
        if page.startswith("<!--", j):
            k = page.find("-->", j + 4)
            i = n if k < 0 else k + 3
            continue
        if page.startswith("<![CDATA[", j):
            k = page.find("]]>", j + 9)
            yield "data", page[j + 9 : n if k < 0 else k], ""
            i = n if k < 0 else k + 3
            continue
        tag = TAG.match(page, j + 1)
        if tag is None and page[j + 1 : j + 2] not in ("!", "?", "/"):
            yield "text", "<", ""
            i = j + 1
            continue
        begin = tag.end() if tag else j + 1
        k = REST.match(page, begin).end() if quotes else page.find(">", begin)
        if quotes and page[k : k + 1] != ">":  # a quote without its other end
            quotes, k = False, page.find(">", begin)
        if k < 0:
            yield "text", page[j:], ""
            return
        i = k + 1
        if tag is None:
            continue
        name, attributes = tag[2].lower(), page[begin:k]
        yield ("end" if tag[1] else "start"), name, attributes
        if name in RAW and not tag[1] and not attributes.rstrip().endswith("/"):
            close = closing(name).search(page, i)  # markup characters are text up to there
            i = close.end() if close else n


@lru_cache(100)
def closing(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?:\\s[^>]*+)?>", re.I)


def deeper(outer: str, label: str) -> str:
    """One label for a container below ``DEEP`` others and those around it there: a digest, and what their names say."""
    names = outer.split(".")[2:]
    if is_boilerplate(label) and "hidden" not in names:
        names.append("hidden")
    if content_rank(label) == 2 and "main" not in names:
        names.append("main")
    return ".".join(("div", blake2b(f"{outer}/{label}".encode("utf-8", "surrogatepass"), digest_size=12).hexdigest().translate(LETTERS), *names))


def path_of(open_tags: list[tuple[str, str]]) -> str:
    """Path of the open containers; the last label tells of all those below ``DEEP``."""
    return "/".join(label for _, label in open_tags[:DEEP] + open_tags[DEEP:][-1:])


def blocks(page: str) -> Iterator[tuple[str, bool, str]]:
    """(path of open containers, whether it is a link, text) of each block in page order."""
    open_tags: list[tuple[str, str]] = []
    held: list[str] = []
    link_chars = chars = depth = 0
    hidden = ""

    def flush() -> Iterator[tuple[str, bool, str]]:
        nonlocal held, link_chars, chars
        text = " ".join("".join(held).split())
        if text:
            yield path_of(open_tags), link_chars * 2 > chars, text
        held, link_chars, chars = [], 0, 0

    for kind, tag, attributes in tokens(page):
        if hidden:
            hidden = "" if kind == "end" and tag == hidden else hidden
            continue
        if kind in ("text", "data"):
            held.append(entities.unescape(tag) if kind == "text" else tag)
            size = len(held[-1].strip())
            chars, link_chars = chars + size, link_chars + size * (depth > 0)
            continue
        end = kind == "end"
        if tag == "a":
            depth = max(0, depth + (-1 if end else 1))
        if tag in HIDDEN and not end and not attributes.rstrip().endswith("/"):
            hidden = tag
        if tag in RAW or tag in HIDDEN or tag in VOID:
            held.append(" ")
            continue
        if tag in INLINE:
            continue
        yield from flush()
        if tag in CONTAINER:
            if not end:
                label = ".".join((tag, *names_of(attributes)))
                open_tags.append((tag, label if len(open_tags) < DEEP else deeper(open_tags[-1][1] if len(open_tags) > DEEP else "", label)))
            elif any(t == tag for t, _ in open_tags):
                while open_tags.pop()[0] != tag:
                    pass
    yield from flush()


@lru_cache(20_000)
def is_boilerplate(path: str, by_name: bool = True) -> bool:
    """Whether a container of the path is marked up, or (``by_name``) named by its last or all its words, as no main text."""
    inside = False
    for label in path.split("/"):
        tag, *names = label.split(".")
        if (tag in NOT_MAIN and not (tag == "header" and inside)) or "hidden" in names:
            return True
        inside = inside or tag in ("article", "main")  # whose own header is theirs
        for name in names if by_name else ():
            parts = [w.lower() for w in WORD.findall(name)]
            if "".join(parts) in NOT_MAIN_WORDS or (parts and parts[-1] in NOT_MAIN_WORDS - {"header"}) or (NOT_MAIN_WORDS.intersection(parts) and NOT_MAIN_WORDS.union(PLAIN_WORDS).issuperset(parts)):
                return True
    return False


@lru_cache(20_000)
def content_rank(path: str) -> int:
    """2: inside an article or main element, 1: inside a container named as content, 0: neither."""
    rank = 0
    for label in path.split("/"):
        tag, *names = label.split(".")
        if tag in ("article", "main") or "main" in names or "article" in names:
            rank = 2
        elif rank < 1 and any(MAIN_WORDS & {*(w.lower() for w in WORD.findall(n)), n.lower()} for n in names):
            rank = 1
    return rank


def key_of(x: dict) -> tuple:
    return tuple(map(key_of, x["group"])) if "group" in x else (x["path"], x["link"])


def collapse(page: list[tuple[str, bool, str]], name: str = "") -> list[dict]:
    """Fields of one page (``name`` tells it from others); ``at`` holds the places of a field's blocks."""
    out: list[dict] = []
    for i, (path, link, text) in enumerate(page):
        if out and out[-1]["path"] == path and out[-1]["link"] == link:
            out[-1]["many"] = True
            out[-1]["chars"] += len(text)
            out[-1]["at"].append(i)
        else:
            out.append({"path": path, "link": link, "many": False, "optional": False, "literal": text, "chars": len(text), "seen": [name], "at": [i]})
    for f in out:
        if f["many"]:  # several blocks are compared by a digest
            f["literal"] = blake2b("\n".join(page[i][2] for i in f["at"]).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
    return out


def folded(fields: list[dict]) -> list[dict]:
    """Elements with sequences that follow themselves put together as repeated groups, short ones first."""
    size, names = 2, numbered(fields)
    while size <= len(fields) // 2:
        starts = repeats(names, size)
        if not len(starts):
            size += 1
            continue
        keys = [key_of(f) for f in fields]
        fewer = grouped(fields, {tuple(keys[i : i + size]) for i in starts})
        size = 2 if len(fewer) < len(fields) else size + 1
        fields, names = fewer, numbered(fewer)
    return fields


def numbered(fields: list[dict]) -> np.ndarray:
    """A number for each element's key, equal for equal keys."""
    known: dict[tuple, int] = {}
    return np.array([known.setdefault(key_of(f), len(known)) for f in fields], dtype=np.int64)


def repeats(names: np.ndarray, size: int) -> np.ndarray:
    """First places of the sequences of ``size`` elements that follow themselves."""
    run = np.concatenate(([0], np.cumsum(names[:-size] == names[size:])))
    return np.flatnonzero(run[size:] - run[:-size] == size)


def grouped(fields: list[dict], patterns: set[tuple]) -> list[dict]:
    """Elements with each sequence of one of those keys put together as a group, repeated if it follows itself."""
    sizes = sorted({len(p) for p in patterns}, reverse=True)
    keys = [key_of(f) for f in fields] if sizes else []
    out: list[dict] = []
    i = 0
    while i < len(fields):
        n = next((n for n in sizes if tuple(keys[i : i + n]) in patterns), 0)
        if not n:
            out.append(fields[i])
            i += 1
            continue
        out.append({"group": fields[i : i + n], "many": False, "optional": False})
        i += n
    return joined(out)


def joined(fields: list[dict]) -> list[dict]:
    """``fields``, where neighbours of one key are one repeated element."""
    out = []
    for _, run in groupby(fields, key_of):
        run = list(run)
        out.append(run[0] if len(run) == 1 else united(run) | {"many": True, "optional": all(x["optional"] for x in run)})
    return out


def united(some: list[dict]) -> dict:
    """Element that takes what all of ``some``, of one key, take: literals that differ become a slot."""
    first = some[0]
    both = {"many": any(x["many"] for x in some), "optional": any(x["optional"] for x in some)}
    if "group" in first:
        return both | {"group": [united(list(x)) for x in zip(*(x["group"] for x in some), strict=True)]}
    literal = first["literal"] if all(x["literal"] == first["literal"] for x in some) else None
    both |= {"path": first["path"], "link": first["link"], "chars": sum(x["chars"] for x in some), "seen": few(*(x["seen"] for x in some)), "literal": literal}
    return both | ({"at": [i for x in some for i in x["at"]]} if all("at" in x for x in some) else {})


def group_keys(fields: list[dict]) -> set[tuple]:
    out = {key_of(f) for f in fields if "group" in f}
    return out.union(*(group_keys(f["group"]) for f in fields if "group" in f))


def aligned(fields: list[dict], patterns: set[tuple]) -> list[dict]:
    """Elements with the other side's groups put together too, smaller ones first."""
    for p in sorted(patterns - group_keys(fields), key=lambda p: (depth_of(p), len(p), p)):
        fields = grouped(fields, {p})
    return fields


def depth_of(key: tuple) -> int:
    return 1 + max(map(depth_of, key)) if key and isinstance(key[0], tuple) else 0


def merge(wrapper: list[dict], page: list[dict]) -> list[dict]:
    """The wrapper generalised to match the page (or other wrapper) too: mismatches become optional, repeated or slots.

    Where the token streams differ, sequences that follow themselves on either side are tried as
    repeated groups; they stay if less is left over.
    """
    wrapper, page = aligned(wrapper, group_keys(page)), aligned(page, group_keys(wrapper))
    codes, over = alignment(wrapper, page)
    if over:
        patterns = group_keys(folded(wrapper)) | group_keys(folded(page))
        both = aligned(wrapper, patterns), aligned(page, patterns)
        other, less = alignment(*both)
        if less < over:
            (wrapper, page), codes = both, other
    out: list[dict] = []
    for kind, a, b, c, d in codes:
        if kind == "equal":
            out += [united([f, g]) for f, g in zip(wrapper[a:b], page[c:d], strict=True)]
        else:
            out += [f | {"optional": True} for f in wrapper[a:b]] + [g | {"optional": True} for g in page[c:d]]
    return joined(out)


def alignment(wrapper: list[dict], page: list[dict]) -> tuple[list[tuple], int]:
    """(edit steps, fields that only one side has)."""
    keys = [[key_of(f) for f in w] for w in (wrapper, page)]
    if keys[0] == keys[1]:
        return [("equal", 0, len(wrapper), 0, len(page))], 0
    codes = SequenceMatcher(None, *keys, autojunk=False).get_opcodes()
    rest = [wrapper[a:b] + page[c:d] for kind, a, b, c, d in codes if kind != "equal"]
    return codes, sum(1 for part in rest for _ in leaves(part))


def few(*names: list[str]) -> list[str]:
    """Names of up to ``CONSTANT`` distinct pages of all."""
    return sorted({x for some in names for x in some})[:CONSTANT]


def structure(page: list[tuple[str, bool, str]]) -> str:
    """Name of a page's structure: its outermost containers of the best content rank, or all that may hold main text."""
    paths = {p for p, link, _ in page if not link and not is_boilerplate(p)}
    top = max(map(content_rank, paths), default=0)
    if top:
        paths = {outermost(p, top) for p in paths if content_rank(p) == top}
    return blake2b("\n".join((str(top), *sorted(paths))).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


@lru_cache(20_000)
def outermost(path: str, rank: int) -> str:
    labels = path.split("/")
    return next(x for x in ("/".join(labels[: i + 1]) for i in range(len(labels))) if content_rank(x) == rank)


def leaves(fields: list[dict]) -> Iterator[dict]:
    for f in fields:
        yield from leaves(f["group"]) if "group" in f else (f,)


def expression(fields: list[dict]) -> str:
    """The wrapper as a regular expression, to read."""
    out = []
    for f in fields:
        inner = expression(f["group"]) if "group" in f else f"{f['path']}{' a' if f['link'] else ''}: {'#text' if f['literal'] is None else repr(f['literal'])}"
        out.append(f"({inner}){'+' if f['many'] else ''}{'?' if f['optional'] else ''}")
    return "".join(out)


@lru_cache(20_000)
def region_of(path: str) -> tuple[str, int]:
    """(container that stands for the path's region, its rank in ``NAMED``)."""
    labels = path.split("/")
    if is_boilerplate(path):
        return next(x for x in ("/".join(labels[: i + 1]) for i in range(len(labels))) if is_boilerplate(x)), -1
    rank = content_rank(path)
    return (outermost(path, rank) if rank else path), rank


def with_main(wrapper: list[dict]) -> list[dict]:
    """The wrapper with ``main`` on the fields of the region that holds the article."""
    fields = list(leaves(wrapper))
    varied: Counter = Counter()
    fixed: Counter = Counter()
    template = {id(f) for f in fields if f["literal"] is not None and len(f["seen"]) >= CONSTANT}
    for f in fields:
        if not f["link"] and not is_boilerplate(f["path"], False):
            (fixed if id(f) in template else varied)[region_of(f["path"])] += f["chars"]
    weight = {r: (varied[r] + fixed[r] * FIXED) * NAMED[r[1]] for r in {*varied, *fixed}}
    if not weight:
        for f in fields:
            f["main"] = False
        return wrapper
    lead, rank = max(weight, key=lambda r: (weight[r], -len(r[0]), r[0]))
    best = {p for p, r in weight if r == rank and (varied[p, r] or not varied[lead, rank])} if rank > 0 else {lead}
    drops = rank < 1 and varied[lead, rank] > fixed[lead, rank] * FIXED  # fixed text of a region that nothing names as content
    for f in fields:
        path = f["path"]
        inside = any(path == p or path.startswith(p + "/") for p in best)
        f["main"] = inside and not is_boilerplate(path if rank >= 0 else path[len(lead) + 1 :]) and not (drops and id(f) in template)
    return wrapper


def matched(wrapper: list[dict], page: list[dict]) -> list[int] | None:
    """Places of the page's blocks that main fields of the wrapper take; None if the wrapper doesn't match the page."""

    def takes(w: dict, x: dict) -> bool:
        if key_of(w) != key_of(x) or (x["many"] and not w["many"]):
            return False
        if "group" in w:
            return all(takes(a, b) for a, b in zip(w["group"], x["group"], strict=True))
        return w["literal"] is None or w["literal"] == x["literal"]

    out: list[int] = []
    at = 0
    for x in aligned(page, group_keys(wrapper)):
        while at < len(wrapper) and not takes(wrapper[at], x):
            if not wrapper[at]["optional"]:
                return None
            at += 1
        if at == len(wrapper):
            return None
        for w, y in zip(leaves([wrapper[at]]), leaves([x]), strict=True):
            out += y["at"] if w["main"] else []
        at += 1
    return out if all(w["optional"] for w in wrapper[at:]) else None


def by_fields(wrapper: list[dict], page: list[dict]) -> list[int] | None:
    """Places of the blocks in main fields, each field by the wrapper's of its container, with equal text or else a slot; None if there is none."""
    known: dict[tuple, dict[str | None, bool]] = {}
    for w in leaves(wrapper):
        of = known.setdefault(key_of(w), {})
        of[w["literal"]] = of.get(w["literal"], False) or w["main"]
    out: list[int] = []
    for x in leaves(page):
        of = known.get(key_of(x))
        if of is None or (x["literal"] not in of and None not in of):
            return None
        out += x["at"] if of.get(x["literal"], of.get(None)) else []
    return out


def extract(page: str | None, wrapper: list[dict] | None) -> str:
    """Main text of a page by its structure's wrapper, or by one of its own if there is none that knows its fields."""
    if not page:
        return ""
    found = list(blocks(page))
    own = collapse(found)
    places = matched(wrapper, own) if wrapper else None
    if places is None and wrapper:
        places = by_fields(wrapper, own)
    if places is None:
        places = matched(with_main(own), own) or []
    return " ".join(found[i][2] for i in sorted(places))


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, structure, wrapper as JSON), inferred from all pages."""
    named = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).where("html is not null")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[dict]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"host": [h for h, _ in held], "structure": [t for _, t in held], "fields": [json.dumps(w) for w in held.values()]}, pa.schema([("host", pa.string()), ("structure", pa.string()), ("fields", pa.string())]))

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = page.as_py()
                found = list(blocks(page))
                key = host, structure(found)
                fields = collapse(found, blake2b(page.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest())
                for f in leaves(fields):
                    del f["at"]
                if key in held:
                    held[key] = merge(held[key], fields)
                else:
                    held[key] = fields
                    size += len(page)
                if size > HELD_CHARS:
                    yield out()
                    held, size = {}, 0
        if held:
            yield out()

    def aligned_partials(t: pa.Table) -> list[dict]:
        wrapper: list[dict] | None = None
        for fields in sorted(t.column("fields").to_pylist()):
            wrapper = json.loads(fields) if wrapper is None else merge(wrapper, json.loads(fields))
        return wrapper

    def some(t: pa.Table) -> pa.Table:
        first = {c: [t.column(c)[0].as_py()] for c in ("host", "structure", "task")}
        return pa.table(first | {"fields": [json.dumps(aligned_partials(t))]}, pa.schema([("host", pa.string()), ("structure", pa.string()), ("task", pa.int32()), ("fields", pa.string())]))

    def whole(t: pa.Table) -> pa.Table:
        return pa.table({"host": [t.column("host")[0].as_py()], "structure": [t.column("structure")[0].as_py()], "wrapper": [json.dumps(with_main(aligned_partials(t)))]})

    parts = named.mapInArrow(partial, "host string, structure string, fields string").withColumn("task", F.spark_partition_id())
    for _ in range(2):  # the wrappers of FAN_IN ** 3 tasks
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("host", "structure", "task").applyInArrow(some, "host string, structure string, task int, fields string")
    return parts.groupBy("host", "structure").applyInArrow(whole, "host string, structure string, wrapper string")


def extract_main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without ``html``, plus ``text`` (string) and ``n_chars`` (long)."""
    rest = [c for c in pages.columns if c != html]
    rest = [c for c in rest if c.lower() not in {"text", "n_chars"}]
    found = wrappers(pages, url, html).toDF("__host", "__structure", "__wrapper")
    found = broadcast_if_small(found)
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [None if page is None else structure(list(blocks(page))) for page in (x.as_py() for x in batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=[*batch.schema.names, "__s"])

    wide = pages.select(*[F.col(f"`{c}`") for c in rest], host_of(url).alias("__h"), F.col(html).alias("__html"))
    wide = wide.mapInArrow(name, ", ".join(x for x in (fields, "__h string, __html string, __s string") if x))
    wide = wide.join(found, (F.col("__h") == F.col("__host")) & (F.col("__s") == F.col("__structure")), "left").select(*[F.col(f"`{c}`") for c in rest], "__html", "__wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            n = batch.num_columns
            texts = []
            for page, w in zip(batch.column(n - 2), batch.column(n - 1), strict=True):
                w = w.as_py()
                if w not in parsed:
                    if len(parsed) > 1000:
                        parsed = {None: None}
                    parsed[w] = json.loads(w)
                texts.append(extract(page.as_py(), parsed[w]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*batch.schema.names[: n - 2], "text", "n_chars"])

    return wide.mapInArrow(run, f"{fields}, text string, n_chars long")


def op10_query(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages)
