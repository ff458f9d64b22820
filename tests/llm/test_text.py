"""Decontamination, fingerprints, Jaccard join, licences and chat formatting against plain Python."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joinloom.llm import chat, decontamination, fingerprints, jaccard, licenses
from joinloom.llm.shared import Words, word_hashes, words_of

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(40)] + ["Étude", "naïve", "ß", "x1"]


def sentence(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def near(text, changes, rng=RNG):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.randrange(1000)}"
    return " ".join(words)


@pytest.mark.parametrize("kind", ["space", "mark"])
def test_words_of_arrays_and_of_regular_expressions(kind):
    texts = ["", "A bC\x0bd\x1ce", "É,ÀB-c_d 12x", " \t\n", "日本 x y", sentence(50), "ab", "cd", "\x7f\x80"]
    w = Words(pa.array(texts, pa.large_string()), kind)
    want = [words_of(t, kind) for t in texts]
    assert [w.word(i) for i in range(len(w.starts))] == sum(want, [])
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    assert (word_hashes(sum(want, [])) == w.hashes).all()


def brute_contamination(docs, items, size=10):
    windows = {}
    for item, text in items:
        words = words_of(text, "mark")
        for k in range(max(1, len(words) - size + 1)) if words else ():
            windows.setdefault(tuple(words[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text, "mark"), set(), set()
        for window, owners in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= owners
        out.append((-1 if doc is None else doc, len(words), len(hit), tuple(sorted(found))))
    return sorted(out)


BENCHMARK = [(1, sentence(14)), (2, sentence(30)), (10, "alpha beta gamma"), (3, None), (4, ""), (None, sentence(11)), (5, "Same Same same same same same same same same same same"), (6, sentence(14))]
DOCS = [
    (1, None), (2, ""), (3, sentence(80)), (4, f"{sentence(5)} {BENCHMARK[0][1].upper()} {sentence(5)}"), (4, "alpha, BETA; gamma!"), (None, f"x {BENCHMARK[5][1]}"),
    (6, " ".join(BENCHMARK[1][1].split()[:12])), (7, "same " * 30), (8, " ".join(BENCHMARK[0][1].split()[:9])), (9, "alpha beta"), (10, "gamma"), (11, f"{BENCHMARK[7][1]} {BENCHMARK[7][1]}"),
]


@pytest.mark.parametrize("block_bytes", [1 << 20, 120])
def test_contamination(spark, docs_of, block_bytes):
    items = spark.createDataFrame(BENCHMARK, "item_id bigint, text string").withColumn("spans", F.lit(1))
    got = decontamination.contamination(docs_of(DOCS), items, block_bytes=block_bytes).collect()
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, sum(s.end - s.begin for s in r.spans), tuple(r["items"])) for r in got)
    assert rows == brute_contamination(DOCS, BENCHMARK)
    assert all(a.end < b.begin for r in got for a, b in itertools.pairwise(r.spans))


def test_contamination_of_empty_tables(spark, docs_of):
    items = spark.createDataFrame(BENCHMARK, "item_id bigint, text string")
    assert decontamination.contamination(docs_of([]), items).count() == 0
    assert decontamination.contamination(docs_of(DOCS), items.limit(0)).where(F.size("spans") > 0).count() == 0


def test_proximity(docs_of):
    index = decontamination.build_index(docs_of([(1, "a x x b x c"), (2, "c b a"), (3, "a b"), (4, "c x x x x x a b"), (5, None)]))
    got = {tuple(r) for r in decontamination.proximity(index, ["a", "b", "c"], 6).collect()}
    assert got == {(1, 0), (2, 0)}
    assert {tuple(r) for r in decontamination.proximity(index, ["b", "a"], 2).collect()} == {(2, 1), (3, 0), (4, 6)}


def test_fingerprints_follow_edits(docs_of):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 900))) for _ in range(30)]
    rows = [*enumerate(texts, 10), (5, None), (6, ""), (7, "ab"), (7, "ab"), (None, "no id"), (99, texts[0])]
    got = fingerprints.against_neighbours(docs_of(rows).repartition(3), 5, 2, 32).collect()
    ordered = sorted(((-(1 << 63) if i is None else i), t or "") for i, t in rows)
    want = []
    for (i, t), (_, u) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        cut = len(t) // 4
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + u[:cut]).encode()).hexdigest()))
    assert sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.doc_id, []).append(r.fingerprint)
    assert by_text[10] == by_text[99] and len(set(by_text[7])) == 1 and by_text[5] == by_text[6]
    long = [r for r in got if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.2 > 0.05 > np.mean([r.near_next for r in long if r.doc_id != 39])
    assert fingerprints.against_neighbours(docs_of([])).count() == 0
    one = fingerprints.against_neighbours(docs_of([(1, "alone in the world")])).first()
    assert one.near_next == 1.0


def test_order_matters_to_fingerprints():
    h = fingerprints.OrderMinHash(5, 2, 64)
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefghij") for _ in range(600))
    swapped = text[300:] + text[:300]
    plain = fingerprints.OrderMinHash(5, 1, 64)
    assert plain.likeness(plain.sketch(text), plain.sketch(swapped)) > 0.9
    assert h.likeness(h.sketch(text), h.sketch(swapped)) < 0.75
    assert h.likeness(h.sketch(text), h.sketch(text)) == 1


def brute_components(rows, size=5, percent=80):
    sets = []
    for _, t in rows:
        w = words_of(t, "space")
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    lead = list(range(len(rows)))

    def find(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            lead[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if (c := low.get(find(i)) if sets[i] else d) is None else c) for i, (d, _) in enumerate(rows))


def families(seed):
    """Near copies around the threshold, chains of them, shared passages, exact copies, and odd rows."""
    rng = random.Random(seed)
    rows, passage = [], sentence(60, rng)
    for _ in range(12):
        base = sentence(rng.randrange(20, 120), rng)
        rows += [near(base, rng.randrange(0, 6), rng) for _ in range(rng.randrange(1, 8))]
        chain = base
        for _ in range(3):
            chain = near(chain, 2, rng)
            rows.append(chain)
    rows += [f"{sentence(rng.randrange(3, 30), rng)} {passage} {sentence(rng.randrange(0, 9), rng)}" for _ in range(40)]
    rows += ["one two", "One  TWO", "one", "", None, " \n", "a b c d e", "a b c d e"]
    rng.shuffle(rows)
    return [*enumerate(rows, 100), (None, rows[3]), (None, "no id at all"), (100, rows[0]), (101, sentence(9, rng))]


@pytest.mark.parametrize("seed", [1, 2])
def test_components(docs_of, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "GROUP", 2)
    rows = families(seed)
    got = jaccard.similar(docs_of(rows).repartition(3)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_components(rows)


def test_links_that_no_leader_finds(docs_of, monkeypatch):
    """Without step 1, the matrix alone finds every link."""
    monkeypatch.setattr(jaccard, "ALIKE", 99)
    monkeypatch.setattr(jaccard, "COMMON", 1)
    rows = families(3)
    got = jaccard.similar(docs_of(rows), percent=60).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_components(rows, percent=60)


def test_components_of_nothing(docs_of):
    assert jaccard.similar(docs_of([])).count() == 0


def brute_licenses(docs, notices, least=0.8):
    import re

    grams = lambda t: (lambda w: {(a, b) for a, b in itertools.pairwise(w)})([x for x in re.split(r"[\W_]+", t.lower()) if x])
    found = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        for unit in [*lines, *([text] if len(lines) > 1 else [])]:
            a = grams(unit)
            for name, texts in notices.items():
                for t in texts:
                    b = grams(t)
                    if a and b and 2 * len(a & b) / (len(a) + len(b)) >= least:
                        units, best = found.get((doc, name), (set(), 0))
                        found[doc, name] = units | {frozenset(a)}, max(best, 2 * len(a & b) / (len(a) + len(b)))
    return {k: (len(u), b) for k, (u, b) in found.items()}


def test_license_scan(spark, docs_of):
    rows = [
        (1, None), (2, ""), (3, "MIT"), (4, "Released under the MIT license!\nmore text here\nreleased UNDER the mit license"), (5, "Licensed under the Apache License, Version 2.0."),
        (6, "Licensed under the\nApache License, Version 2.0."), (7, sentence(2000)), (None, "All rights reserved."), (4, "all rights reserved"), (8, "licensed under cc by-nc 4.0\n" * 3), (9, "\n\n"),
    ]
    got = {(r.doc_id, r.license): (r.n_units, r.best_dice) for r in licenses.license_scan(docs_of(rows), licenses.templates(spark)).collect()}
    assert got == brute_licenses(rows, licenses.NOTICES) and (6, "Apache-2.0") in got
    assert licenses.license_scan(docs_of([]), licenses.templates(spark)).count() == 0
    assert licenses.license_scan(docs_of(rows), licenses.templates(spark, {})).count() == 0


def test_chats_read_back(spark):
    odd = ["", None, "<|im_end|>\n<|im_start|>user\nhi", "\\s\\l[INST]\\\\", "</s>[INST] ok [/INST]", "a\nb\n", "<|turn|>", "🙂 é", "x" * 70_000]
    rows = [(c, t, role, odd[(c * 7 + t) % len(odd)]) for c in range(9) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", None, "assistant"])]
    rows += [(50, 1, "assistant", "b"), (50, 1, "assistant", "a"), (50, 1, "assistant", "a"), (50, None, "user", "first"), (None, 0, "user", "x"), (60, 0, "odd\nrole<[", "t"), (70, 0, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "'z' AS formatted", "1 AS parts")
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_chats(formatted).collect()}
    raw = {r.conv_id: r for r in formatted.collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        assert sorted((t.role, t.text) for t in got[conv].turns) == sorted((r[2] or "", r[3] or "") for r in mine)
        if conv != 50:
            assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in mine]
            assert got[conv].loss_text == "".join(r[3] or "" for r in mine if r[2] == "assistant")
        text = raw[conv].formatted
        assert text.count(chat.START) == sum(1 for _ in itertools.groupby(t.role for t in got[conv].turns))
        assert len(raw[conv].loss) == sum(r[2] == "assistant" for r in mine)
    assert [t.text for t in got[50].turns] == ["first", "a", "a", "b"]
    assert chat.format_chats(df.limit(0)).count() == 0
