"""Toxicity, deleted interpolation and the pipeline against plain Python and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from joinloom.llm import interpolation, toxicity
from joinloom.llm.shared import words_of

RNG = random.Random(21)
CLEAN = ["the", "river", "stone", "light", "walks", "near", "house", "green", "apple", "music", "group", "people", "idea", "chair"]


def toxic_rows(n=900):
    """Insults alone, and one word that is only bad next to another."""
    rows, labels = [], []
    for i in range(n):
        words = [RNG.choice(CLEAN) for _ in range(RNG.randrange(4, 60))]
        kind = RNG.randrange(6)
        if kind == 0:
            words[RNG.randrange(len(words))] = RNG.choice(["blorgish", "blorging", "blorgs"])
        elif kind == 1:
            words += ["zark", "folken"]
        elif kind == 2:
            words += ["zark"]
        elif kind == 3:
            words += ["folken"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind < 2)))
    return rows, labels


def test_toxicity_learns_words_beginnings_and_pairs(spark, docs_of):
    rows, labels = toxic_rows()
    docs = docs_of([*rows, (5000, None), (5001, ""), (None, "blorgs"), (5002, "a blorgified thing of the house"), (5003, "words " * 5000 + "blorgs")])
    given = spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id bigint, toxic int").withColumn("text", F.lit("shadow"))
    machine = toxicity.train(docs, given)
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert len(got) == len(rows) + 5 and all(0 <= s <= 1 for s in got.values())
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(y) for i, y in held)
    assert right >= 0.97 * len(held) and len(held) > 100
    assert got[5000] == got[5001] < 0.5 and got[5002] >= 0.5 and got[5003] >= 0.5


def test_scores_use_the_text_alone(spark, docs_of):
    rows, labels = toxic_rows(300)
    given = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.train(docs_of(rows), given)
    plain = {r.doc_id: r.score for r in toxicity.score(docs_of(rows), machine).collect()}
    other = docs_of([(i + 7, t) for i, t in rows]).withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    assert {r.doc_id - 7: r.score for r in toxicity.score(other, machine).collect()} == plain


def test_toxicity_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows, _ = toxic_rows(20)
    machine = toxicity.train(docs_of(rows), none)
    assert {r.score for r in toxicity.score(docs_of(rows), machine).collect()} == {0.5}
    assert toxicity.score(docs_of([]), machine).count() == 0
    one = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id bigint, toxic int")
    assert all(r.score < 0.01 for r in toxicity.score(docs_of(rows), toxicity.train(docs_of(rows), one)).collect())


def test_machine_equals_its_formula():
    rng = np.random.default_rng(3)
    chosen = np.arange(toxicity.TERMS - toxicity.LENGTHS, toxicity.TERMS)
    m = toxicity.Machine(chosen, 0.3, rng.normal(size=len(chosen)), rng.normal(size=(len(chosen), 4)))
    got = m.raw(np.array([0, 0, 0, 2]), np.array([1, 4, 7, 3]), 3)
    at = [1, 4, 7]
    want = 0.3 + m.weights[at].sum() + sum(m.factors[i] @ m.factors[j] for k, i in enumerate(at) for j in at[k + 1 :])
    assert got == pytest.approx([want, 0.3, 0.3 + m.weights[3]])


def brute_interpolation(docs, weights):
    tokens = {k: [*words_of(t, "space"), None] for k, (_, t) in enumerate(docs)}
    train = [k for k, (i, _) in enumerate(docs) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    words, pairs = Counter(), Counter()
    for k in train:
        words.update(tokens[k])
        pairs.update(zip([0, *tokens[k]], tokens[k], strict=False))
    n, v = sum(words.values()), len(words)
    out = []
    for k, (i, _) in enumerate(docs):
        base = score = 0.0
        for h, w in zip([0, *tokens[k]], tokens[k], strict=False):
            before = words[None] if h == 0 else words[h]
            a = weights[1 + min(int(math.log2(before)), interpolation.BUCKETS - 2) if before else 0]
            base += math.log10((words[w] + 1) / (n + v + 1))
            score += math.log10(a[0] * pairs[h, w] / max(before, 1) + a[1] * words[w] / max(n, 1) + a[2] / (v + 1))
        out.append((-1 if i is None else i, k not in train, len(tokens[k]), sum(words[w] > 0 for w in tokens[k]), n, base, score))
    return sorted(out)


def test_interpolation(docs_of, monkeypatch):
    monkeypatch.setattr(interpolation, "BATCH", 2000)
    seen = {}
    learn = interpolation.learn
    monkeypatch.setattr(interpolation, "learn", lambda cells, v: seen.setdefault("weights", learn(cells, v)))
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(CLEAN) + rng.choice(["", "", "s", "X"]) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "no id here"), (3, rows[3][1]), (502, "unseen! words? ünd more")]
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in interpolation.scores(docs_of(rows).repartition(3)).collect())
    want = brute_interpolation(rows, seen["weights"])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]], rel=1e-9)
    assert (seen["weights"] > 0).all() and seen["weights"].sum(axis=1) == pytest.approx(np.ones(interpolation.BUCKETS))


def test_interpolation_beats_the_base_on_held_out_text(docs_of):
    rng = random.Random(6)
    follow = {w: rng.sample(CLEAN, 3) for w in CLEAN}

    def text():
        words = [rng.choice(CLEAN)]
        for _ in range(40):
            words.append(rng.choice(follow[words[-1]]))
        return " ".join(words)

    got = [r for r in interpolation.scores(docs_of([(i, text()) for i in range(300)])).collect() if r.held_out]
    assert len(got) > 20 and sum(r.score for r in got) > 0.7 * sum(r.base_score for r in got)


def test_interpolation_edges(docs_of):
    assert interpolation.scores(docs_of([])).count() == 0
    left = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = interpolation.scores(docs_of([(left, "never trained")])).first()
    assert r.held_out and r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) and r.base_score == 0


def test_expectation_maximisation_finds_the_mixture():
    # Events drawn from pairs only, in a bucket; from words only, in another.
    cells = np.array([[3, 0, 40, 1000], [3, -1, 0, 1], [5, -1, 8, 500], [5, 0, 80, 1]])
    weights = interpolation.learn(cells, 1000)
    assert weights[3, 0] > 0.95 and weights[5, 1] > 0.9 and weights[0, 0] < 1e-5


def test_batches_keep_documents_and_order():
    tokens = np.array([5, 7, 9, 5, 9, 7, 7, 9], np.uint64)
    row = interpolation.build([1, 2, None], np.array([2, 0, 1]), np.array([3, 2, 3]), tokens)
    assert row["docs"] == [[2, None, 1]]
    words = np.frombuffer(row["words"][0], "<u8")
    assert words[interpolation.unpacked(row["numbers"][0], "<u4")].tolist() == [5, 9, 7, 7, 9, 5, 7, 9]
    x = np.arange(300, dtype="<u4") * 1000
    assert (interpolation.unpacked(interpolation.packed(x), "<u4") == x).all()
    assert pa.array([interpolation.packed(x)]).type == pa.binary()
