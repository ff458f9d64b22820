"""Licence texts, headers and notices within longer texts, against plain Python."""

import itertools
import random
import re

from joinloom.llm import licenses, passages


def brute(docs, notices, least=0.8):
    words = lambda t: [x for x in re.split(r"[\W_]+", t.lower()) if x]
    grams = lambda w: set(itertools.pairwise(w))
    found = {}
    for doc, text in docs:
        text = text or ""
        w = words(text)
        for name, templates in notices.items():
            for k, t in enumerate(templates):
                b, size = grams(words(t)), len(words(t))
                units = [w, *map(words, text.split("\n")), *map(words, re.split(r"\n\s*\n", text)), *(w[i : i + size] for i in range(len(w) - 1) if (w[i], w[i + 1]) in b)]
                best = max((2 * len(a & b) / (len(a) + len(b)) for a in map(grams, units) if a and b), default=0)
                if best >= least:
                    which, most = found.get((doc, name), (set(), 0))
                    found[doc, name] = which | {k}, max(most, best)
    return {k: (len(u), b) for k, (u, b) in found.items()}


def test_licences_within_longer_texts(spark, docs_of):
    rng = random.Random(4)
    filler = lambda n: " ".join(rng.choice(["river", "stone", "of", "the", "license", "software", "this"]) for _ in range(n))
    known = passages.texts()
    small = {k: [t for t in v if len(t) < 2500] for k, v in known.items()}
    mit, bsd, apache = (known[k][-1] for k in ("MIT", "BSD-3-Clause", "Apache-2.0"))
    header = passages.HEADERS["Apache-2.0"][0]
    rows = [
        (1, mit), (2, filler(300) + "\n\n" + mit + "\n\n" + filler(200)), (3, f"{filler(40)} this work is licensed under the GNU General Public License, version 3. {filler(50)}"),
        (4, f"{filler(30)}\nLicensed under the Apache\nLicense, Version 2.0.\n{filler(30)}"), (5, "# " + header.replace(". ", ".\n# ") + "\nimport os\n" + filler(100)),
        (6, filler(400)), (7, None), (8, ""), (None, bsd), (9, mit[: len(mit) // 2] + filler(200)), (10, filler(50) + " " + passages.HEADERS["GPL-3.0"][0] + " " + filler(50)),
    ]
    got = {(r.doc_id, r.license): (r.n_templates, r.best_dice) for r in passages.license_passages(docs_of(rows), licenses.templates(spark, small)).collect()}
    assert got == brute(rows, small)
    assert {(1, "MIT"), (2, "MIT"), (3, "GPL-3.0"), (4, "Apache-2.0"), (5, "Apache-2.0"), (None, "BSD-3-Clause"), (10, "GPL-3.0")} <= got.keys() and (9, "MIT") not in got
    before = {(r.doc_id, r.license) for r in licenses.license_scan(docs_of(rows), licenses.templates(spark)).collect()}
    assert before <= got.keys() and not {(2, "MIT"), (3, "GPL-3.0"), (4, "Apache-2.0")} & before
    long = [(1, filler(100) + "\n" + apache + "\n" + filler(100))]
    assert ("Apache-2.0", 1.0) in {(r.license, r.best_dice) for r in passages.license_passages(docs_of(long), licenses.templates(spark, known)).collect()}
    assert passages.license_passages(docs_of([]), licenses.templates(spark, small)).count() == 0
    assert passages.license_passages(docs_of(rows), licenses.templates(spark, {})).count() == 0
