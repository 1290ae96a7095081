"""The corpus pipeline: five stages from documents to shards, each written as Parquet and read again.

All stages: rows may repeat, any column may be null, texts may be empty or very
long, further columns of any name are ignored, and an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, mixing, ngram_join, sharding, toxicity
from tessera.llm._io import columns, spread_table, table
from tessera.session import remove, shared_folder

NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7 stay; so null and empty texts stay unless the model's bias alone reaches 0.7.  Equal texts score alike."""
    labels = table(spark, sf_dir, "labels")
    docs = columns(docs, *NAMES)
    model = toxicity.fit(docs.where(~toxicity.held_out(1, 3)), labels)
    return toxicity.with_score(docs, model).where(F.col("score") < 0.7).select(*NAMES)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows the one with the smallest id, and of its texts the one of least hash, stays; of rows equal in id and text, one.  Rows without an id stay."""
    docs = columns(docs, *NAMES).withColumn("same", F.xxhash64("text"))
    copies = ngram_join.grouped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "same")).where("doc_id != first.doc_id or same != first.same").select("doc_id", "same").distinct()
    kept = docs.join(copies, ["doc_id", "same"], "left_anti")
    unnamed = kept.where("doc_id is null").select(*NAMES)
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "same"]).select(*NAMES).unionByName(unnamed)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with 5 % or more of their words in benchmark passages go; null and empty texts have none and stay."""
    return decontamination.clean(columns(docs, *NAMES), table(spark, sf_dir, "benchmark")).select(*NAMES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes, a row for each pass over a document.  Null and empty texts give no words and go; a null source is one of its own; of equal quotients the earlier source's wins."""
    return mixing.mixed(docs, NAMES)


def deal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row whole, with its shard and slot; rows that are equal in all columns are interchangeable."""
    return sharding.dealt(columns(docs, *NAMES))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", deal),
]

#: The model of the first stage cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are Parquet in the shared folder, and go once the next stage is written.

    The last one's input stays for as long as its result may be read: until the session ends.
    """
    docs = spread_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
