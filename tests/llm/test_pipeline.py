"""The pipeline, stage by stage, on planted documents."""

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from joinloom.llm import queries, sql

from .test_models import toxic_rows
from .test_text import BENCHMARK, brute_components, brute_contamination, near, sentence


@pytest.fixture(scope="module")
def folder(spark, docs_of, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rows, labels = toxic_rows()
    base = sentence(120)
    rows = [(i, t + " " + sentence(12)) for i, t in rows]
    rows += [(1000, base), (1001, near(base, 2)), (1002, base), (1003, f"{sentence(20)} {BENCHMARK[0][1]} {sentence(20)}"), (1004, None), (1005, ""), (1006, sentence(3000)), (None, sentence(50)), (1000, base)]
    docs_of(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(BENCHMARK, "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, rows, dict(labels)


def test_stages(spark, folder, tmp_path, vocabulary):
    at, rows, labels = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{len(kept)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        kept[name] = docs.collect()
    clean = [(r.doc_id, r.text) for r in kept["toxicity"]]
    gone = {i for i, _ in rows} - {i for i, _ in clean}
    toxic = {i for i, y in labels.items() if y}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 2
    near_free = [(r.doc_id, r.text) for r in kept["near duplicates"]]
    components = brute_components(clean)
    # A row of each component with words, and every row without.
    assert len(near_free) == len({c for _, n, c in components if n}) + sum(n == 0 for _, n, _ in components)
    assert {1001, 1002}.isdisjoint(i for i, _ in near_free) and sum(i == 1000 for i, _ in near_free) == 1
    decided = brute_contamination(near_free, BENCHMARK)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept["decontamination"]) == sorted(i for i, _, hit, _ in decided if not hit)
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    tokens = sum(len(library.encode(r.text or "", add_special_tokens=False)) + 1 for r in kept["decontamination"])
    assert sum(r.length for r in kept["packing"]) == tokens
    whole = corpus_pipeline.run(spark, at).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.start, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id is not None, r.doc_id, r.start, r.length, r.ids_crc32) for r in kept["packing"])


def test_every_query_has_rows_or_sql(spark, folder):
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in queries.queries()}
    assert set(sql.SQL) <= set(queries.queries())


def test_stages_of_nothing(spark, folder, tmp_path):
    at, _, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, at).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() == 0
