"""All links between distinct texts, against brute force."""

import itertools
import random

from joinloom.llm import jaccard
from joinloom.llm.shared import words_of


def test_every_link_of_a_family(docs_of):
    """A family of unequal near copies has more links than its component needs."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base)), (1, " ".join(base)), (60, None), (61, ""), (62, "a b"), (63, "a  B"), (64, "a c")]
    for k in range(2, 14):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(120)] = f"z{k}"
        rows.append((k, " ".join([*words, f"end{k}"])))
    least, texts = {}, {}
    for i, t in rows:
        w = words_of(t, "space")
        s = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
        if s:
            least[s] = min(i, least.get(s, i))
    want = set()
    for x, y in itertools.combinations(least, 2):
        if 100 * len(x & y) >= 80 * len(x | y):
            want.add((*sorted((least[x], least[y])), len(x & y), len(x | y)))
    got = jaccard.links(docs_of(rows)).collect()
    assert {(min(r.a, r.b), max(r.a, r.b), r.n_both, r.n_either) for r in got} == want and len(got) == len(want)
    assert len(want) > len(least)
    assert jaccard.links(docs_of([])).count() == 0
