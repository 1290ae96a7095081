"""Reading tables and the small plumbing of Arrow stages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import prepare, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``table`` for scans that work long on each row: a file in one piece still occupies all cores."""
    return spread(table(spark, sf_dir, name))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.large_binary()).to_pylist()


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only ``names``: extra columns never reach an operator, even those that differ from a name only in case."""
    known = df.columns
    if len({n.lower() for n in known}) == len(known):
        return df.select(*[F.col(f"`{n}`") for n in names])
    return df.toDF(*[f"c{i}" for i in range(len(known))]).select(*[F.col(f"c{known.index(n)}").alias(n) for n in names])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The whole row as the struct ``row``, whatever its columns are called, beside the columns ``names``."""
    known = df.columns
    safe = df.toDF(*[f"c{i}" for i in range(len(known))])
    return safe.select(F.struct("*").alias("row"), *[F.col(f"c{known.index(n)}").alias(n) for n in names])


def unpacked(df: DataFrame, names: list[str]) -> DataFrame:
    """The rows that ``packed`` put into ``row``, by their own names again."""
    return df.select("row.*").toDF(*names)


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for f, c in ((f, cols[f.name]) for f in schema)], schema=schema)


def arrow_schema(**types) -> pa.Schema:
    return pa.schema([pa.field(k, v) for k, v in types.items()])


Batches = Iterator[pa.RecordBatch]
