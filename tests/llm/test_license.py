"""The license query against a plain scan of each document."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SCHEMA, awkward_rows, sentence, write_tables  # noqa: E402

from tierlink.llm import license_scan as L  # noqa: E402

CUE = re.compile(L.CUE)
ANY = re.compile(L.CUE + L.MORE_CUES)
WORD = re.compile(L.WORD)


def deciding(text):
    x = (text.strip(" ")[: L.HEAD] if len(text) > L.LONG else text).lower()
    for a, b in ((r"non-?commercial", "nc"), (r"share-?alike", "sa"), (r"no-?deriv(?:ative)?s?", "nd"), (r"\b(\d)\.0\b", r"\1")):
        x = re.sub(a, b, x)
    return set(re.findall(r"\b(affero|lesser|nc|sa|nd)\b", x)), set(re.findall(r"(?:^|[^\w.])v?([1-4](?:\.\d)?)(?![\w]|\.\d)", x))


class Plain:
    def __init__(self):
        self.templates = L.TEMPLATES + L.WORDINGS + L.full_texts()
        counts = [Counter(WORD.findall(t.lower())) for _, t in self.templates]
        df = Counter(w for c in counts for w in c)
        self.n = len(counts)
        self.idf = {w: math.log(1 + self.n / k) for w, k in df.items()}
        self.vectors = [self.vector(c) for c in counts]
        self.deciding = [deciding(t) for _, t in self.templates]
        self.memo = {}

    def vector(self, counts):
        return {w: (1 + math.log(k)) * self.idf.get(w, math.log(1 + self.n)) for w, k in counts.items()}

    def best(self, text):
        """(license, similarity) of the best template for one line, paragraph or file."""
        if text not in self.memo:
            v, (words, numbers), found = self.vector(Counter(WORD.findall(text.lower()))), deciding(text), []
            norm = math.sqrt(sum(x * x for x in v.values()))
            for i, t in enumerate(self.vectors):
                dot = sum(x * t[w] for w, x in v.items() if w in t)
                if dot:
                    s = round(dot / (norm * math.sqrt(sum(x * x for x in t.values()))), 6)
                    if s >= L.THRESHOLD and words == self.deciding[i][0] and self.deciding[i][1] <= numbers:
                        found.append((-s, i))
            self.memo[text] = (self.templates[min(found)[1]][0], -min(found)[0]) if found else None
        return self.memo[text]


def scanned(rows):
    plain, own, setters, paths = Plain(), {}, {}, {}
    for i, text, lang, source, *_ in rows:
        text = text or ""
        lines = [x for x in text.split("\n") if x.strip(" ")]
        notice = bool(lines) and bool(CUE.search(lines[0]) or CUE.search(lines[-1]))
        # null columns leave their level out of the path
        folder = [x for x in (source, lang) if x is not None] + ([] if (notice and i is not None and i % 3 == 0) or i is None else [f"part{i % 8}"])
        name = None if i is None else f"LICENSE-{i}" if notice else f"{i}.txt"
        at = "/".join([*folder, *([name] if name else [])])
        pieces = [x for x in text.split("\n") if ANY.search(x)] + [x for x in re.split(L.PARAGRAPH, text) if ANY.search(x)]
        marked = re.search("([^/]*)$", at)[1] if at else ""
        mark = bool(re.match(L.FILE_NAME, marked))
        if mark and ANY.search(text):
            pieces.append(text)
        found = [(-(len(p) > L.LONG), -plain.best(p)[1], plain.best(p)[0]) for p in {x.strip(" ") for x in pieces} if plain.best(p)]
        own[at, i, text] = min(found) if found else None
        paths[at, i, text] = at.rpartition("/")[0]
        if mark and found:
            f = paths[at, i, text]
            setters[f] = min(setters.get(f, (1, "")), (min(found)[1], min(found)[2]))
    out = Counter()
    for (at, i, text), best in own.items():
        folder, inherited = paths[at, i, text], None
        while True:
            if folder in setters:
                inherited = setters[folder]
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        got = (best[2], -best[1], "header") if best else (inherited[1], -inherited[0], "folder") if inherited else (None, None, None)
        out[(i, at, *got)] += 1
    return out


NOTICES = ("Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "All rights reserved.", "a driver's license is needed", "// This library is free software; you can redistribute it and/or modify it\n// under the terms of the GNU Lesser General Public License, version 3.")


def test_query_equals_a_plain_scan(spark, tmp_path):
    rng = random.Random(4)
    rows = [r for r in awkward_rows() if r[0] is not None and r[3] is not None and r[1] is not None]
    for i in range(200, 320):
        body = "\n\n".join(sentence(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 4)))
        if rng.random() < 0.4:
            n = rng.choice(NOTICES)
            body = rng.choice((f"{n}\n\n{body}", f"{body}\n\n{n}", f"{body}\n\n{n}\n\n{body}", f"{n}"))
        rows.append((i, body, rng.choice(("en", "de")), f"s{rng.randrange(9)}", 1))
    rows.append((400, dict(L.full_texts())["GPL-2.0"], "en", "full", 1))
    rows.append((401, "nothing of its own", "en", "full", 1))
    rows = list(dict.fromkeys(rows))
    got = Counter(tuple(r) for r in L.op7_query(spark, write_tables(spark, tmp_path / "t", spark.createDataFrame(rows, SCHEMA))).select("doc_id", "path", "license", "similarity", "found_in").collect())
    want = scanned(rows)
    assert {k[:3] + k[4:] for k in got} == {k[:3] + k[4:] for k in want}
    assert all(math.isclose(a[3] or 0, b[3] or 0, abs_tol=2e-6) for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True))
    assert {k[2] for k in got} >= {"CC-BY-NC-4.0", "GPL-3.0", "GPL-2.0", "Apache-2.0", "MIT", "proprietary", "LGPL-3.0"} and {k[4] for k in got} == {"header", "folder", None}
