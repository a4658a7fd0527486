"""From raw documents to a sharded training corpus, in five stages.

1. quality: documents that the classifier rejects go. 2. near_duplicates: one document of each group
of linked ones stays (five-word shingles, similarity from 0.8). 3. decontamination: documents with a
passage of the benchmark go. 4. mixing: sources are repeated towards equal weights, at most
``REPETITIONS`` times; every document stays. 5. sharding: a row of shard and slot for each row.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``. Decisions are
taken for rows, not for ids: stages 1 and 3 judge the text alone, so rows go by its SHA-256 and no copy
of the rows is written; stage 2 tells equal rows apart and numbers the rows first. Defined
cases: of rows that repeat an id each is judged by its own text, and of equal rows the near-duplicate
stage keeps one; rows without an id are treated like any other; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, jaccard, mixing, quality, sharding
from lexmill.llm.store import small, stash, table

#: Most uses of a document in the mixture.
REPETITIONS = 1.5


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs``, written with a number for each row."""
    return stash(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number")), "pipeline-numbered")


def _digest(text: str = "text"):
    """What names a text; null counts as empty, as it does for the operators."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def _by_text(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text has a ``digest`` in ``rejected``."""
    rejected = stash(rejected.select("digest").distinct(), "pipeline-rejected")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _digest().alias("digest"))
    return _rows(rows.join(small(rejected), "digest", "left_anti"))


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in rows.schema["row"].dataType.names])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.classify(docs.select("doc_id", "text", _digest().alias("digest")), table(spark, sf_dir, "labels"), row="digest")
    return _by_text(docs, scored.where("predicted = 0"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    numbered = _numbered(docs)
    linked = jaccard.link(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")))
    rejected = stash(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("number")), "pipeline-rejected")
    return _rows(numbered.join(small(rejected), "number", "left_anti"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.search(docs.select(_digest().alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _by_text(docs, found.withColumnRenamed("doc_id", "digest"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, repetitions=REPETITIONS)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs).withColumn("law", F.lit("rows"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: Training a classifier and latent retrieval are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
