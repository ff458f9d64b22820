"""A corpus pipeline of four stages: toxic documents go, one document of each near-duplicate group stays, documents
with benchmark passages go, and the rest is packed into windows of tokens.

Each stage is a function of (spark, docs, sf_dir) over all that the stage before kept. All but the last return the columns of
documents. Rows are told apart by a number of their own, so null and repeated ids are safe: of repeated rows one stays, since
they are near duplicates; rows without words are no duplicates of anything. An empty table gives an empty one, texts are read whole at any length, and other
columns stay whatever their names: those that a stage adds for its own use have names that are free, and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinloom.llm import decontamination, jaccard, packing, toxicity
from joinloom.llm.shared import free_name, stored, table

#: Row numbers up to which those to drop are broadcast.
FEW = 500_000


def _without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    dropped = stored(dropped.select(row), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= FEW else dropped, row, "left_anti").drop(row)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with numbers of their own, and the column that has them."""
    row = free_name(docs, "row")
    return stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the factorization machine, trained on the labelled rows of ``docs``, scores 0.5 or more."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score(docs, machine, keep=score).where(F.col(score) < 0.5).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates keeps the row of least doc_id."""
    docs, row = _numbered(docs)
    found = jaccard.similar(docs, id_col=row).select(F.col("doc_id").alias(row), "component_id")
    found = stored(found.join(docs.select(row, F.col("doc_id").alias("id")), row), "components")
    stays = found.groupBy("component_id").agg(F.min(F.struct(F.isnull("id"), "id", F.col(row).alias("stays"))).alias("least")).select("component_id", "least.stays")
    return _without(docs, found.join(stays, "component_id").where(F.col(row) != F.col("stays")), row)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a window of a benchmark item."""
    docs, row = _numbered(docs)
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), id_col=row)
    return _without(docs, found.where(F.size("spans") > 0).select(F.col("doc_id").alias(row)), row)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("decontamination", contaminated), ("packing", packed)]
#: A trained model's decisions are beyond SQL; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
