"""The parse as DataFrames: one parse of each document, every table a filter of it."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lexer import lines
from tessera.operators.parser import Options, parse, pieces
from tessera.session import checkpoint, prepare, remove, shared_folder, spread

_PART = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("opening", pa.string())]))
_FIELDS: dict[str, tuple[pa.DataType, str]] = {
    "doc_id": (pa.int64(), "long"),
    "kind": (pa.string(), "string"),
    "node_id": (pa.int32(), "int"),
    "parent_id": (pa.int32(), "int"),
    "pos": (pa.int32(), "int"),
    "depth": (pa.int32(), "int"),
    "type": (pa.string(), "string"),
    "tag": (pa.string(), "string"),
    "raw": (pa.string(), "string"),
    "name": (pa.string(), "string"),
    "value": (pa.string(), "string"),
    "quote": (pa.string(), "string"),
    "equals": (pa.string(), "string"),
    "content": (pa.string(), "string"),
    "opening": (pa.string(), "string"),
    "closing": (pa.string(), "string"),
    "control": (pa.string(), "string"),
    "close": (pa.string(), "string"),
    "close_raw": (pa.string(), "string"),
    "space": (pa.string(), "string"),
    "close_space": (pa.string(), "string"),
    "message": (pa.string(), "string"),
    "direct_text": (pa.string(), "string"),
    "accessible": (pa.bool_(), "boolean"),
    "line": (pa.int32(), "int"),
    "column": (pa.int32(), "int"),
    "range_from": (pa.int32(), "int"),
    "range_to": (pa.int32(), "int"),
    "ancestors": (pa.list_(pa.string()), "array<string>"),
    "branch": (pa.list_(pa.string()), "array<string>"),
    "child_tags": (pa.list_(pa.string()), "array<string>"),
    "dynamic": (pa.list_(pa.string()), "array<string>"),
    "attr": (pa.map_(pa.string(), pa.string()), "map<string,string>"),
    "parts": (_PART, "array<struct<kind:string,text:string,opening:string>>"),
    "name_parts": (_PART, "array<struct<kind:string,text:string,opening:string>>"),
}
SCHEMA = ", ".join(f"{n} {k}" for n, (_, k) in _FIELDS.items())


def parsed(docs: DataFrame, text: str = "source", options: Options | None = None) -> DataFrame:
    """Rows of all kinds for ``docs(doc_id, <text>)``: one scan without a shuffle."""
    prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            rows: list[dict] = []
            for doc, source in zip(b.column("doc_id").to_pylist(), b.column("source").to_pylist(), strict=True):
                for r in parse(source, options):
                    r["doc_id"] = doc
                    rows.append(r)
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return spread(docs.selectExpr("doc_id", f"`{text}` as source")).mapInArrow(run, SCHEMA)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, (k, _) in _FIELDS.items()], names=list(_FIELDS))


#: What a task remembers of pieces, and the most rows of pieces that are broadcast.
_REMEMBERED = 100_000
_BROADCAST = 400_000


def placements(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, above, text) for ``docs(doc_id, source)``: each document's pieces with the lines above them.

    ``piece`` is a 64-bit hash of the piece's text; pieces with equal ids are taken as equal.  A task gives the text
    of a piece once, or for each ``_REMEMBERED`` pieces.
    """

    def run(batches):
        alone: dict[str, bool] = {}
        known: dict[str, int] = {}
        met: list[tuple[int, int]] = []
        for b in batches:
            if max(len(known), len(alone)) > _REMEMBERED:
                alone, known, met = {}, {}, []
            ids, sizes, new = [], [], {}
            for source in b.column("source").to_pylist():
                parts = pieces(source, alone) if source else []
                for text in parts:
                    if (k := known.get(text)) is None:
                        k = known[text] = len(met)
                        key = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
                        met.append((int.from_bytes(key, "big", signed=True), lines(text)))
                        new[len(ids)] = text
                    ids.append(k)
                sizes.append(len(parts))
            piece, rows = np.array(met, np.int64).reshape(-1, 2)[ids].T if ids else np.empty((2, 0), np.int64)
            above, first = np.cumsum(rows) - rows, np.cumsum(sizes) - sizes
            docs_ = np.repeat(np.arange(len(sizes)), sizes)
            above = above - np.append(above, 0)[first][docs_]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(docs_)), pa.array(piece), pa.array(above.astype(np.int32)), pa.array([new.get(k) for k in range(len(ids))] if new else pa.nulls(len(ids)), pa.string())],
                names=["doc_id", "piece", "above", "text"],
            )

    return spread(docs.select(F.col("doc_id").cast("long"), "source")).mapInArrow(run, "doc_id long, piece long, above int, text string")


class Tables:
    """The tables of a corpus ``docs(doc_id, path, source)``.

    With ``keep`` the corpus is parsed once, into Parquet files by kind in the
    shared folder, of which a rule reads the columns it needs; executors may
    come and go.  ``drop`` removes the files when no table is read any more.
    Without it every table that is read parses the corpus.

    With ``apart``, for documents with many lines in common, documents are cut
    into pieces, and ``local`` holds the tables of the distinct pieces, where
    a piece's id is the ``doc_id``.  ``picked`` finds rows there and puts them
    into the documents; every table read past it parses the corpus.
    """

    local: Tables | None = None
    places: DataFrame | None = None

    def __init__(self, docs: DataFrame, text: str = "source", options: Options | None = None, keep: bool = True, apart: bool = False):
        names = docs.columns
        self.docs = docs.select("doc_id", (F.col("path") if "path" in names else F.lit(None).cast("string")).alias("path"), F.col(text).alias("source"))
        self.rows = parsed(docs, text, options)
        self.folder = None
        if apart:
            if options is not None:
                raise ValueError("pieces are cut for the default options")
            spark = prepare(docs.sparkSession)
            self.folder = f"{shared_folder(spark)}/places-{uuid.uuid4().hex}"
            placements(self.docs).write.parquet(self.folder)
            found = spark.read.parquet(self.folder)
            self.places = found.select("doc_id", "piece", "above")
            own = found.where("text is not null").select(F.col("piece").alias("doc_id"), F.col("text").alias("source"))
            self.local = Tables(own.repartition(4 * spark.sparkContext.defaultParallelism, "doc_id").dropDuplicates(["doc_id"]))
        elif keep:
            self.folder = f"{shared_folder(docs.sparkSession)}/parse-{uuid.uuid4().hex}"
            self.rows.write.partitionBy("kind").parquet(self.folder)
            self.rows = docs.sparkSession.read.schema(SCHEMA).parquet(self.folder)

    def drop(self) -> None:
        if self.folder:
            remove(self.docs.sparkSession, self.folder)
        if self.local:
            self.local.drop()

    def picked(self, pick: Callable[[Tables], DataFrame]) -> DataFrame:
        """``pick`` of the tables, where it makes rows of single nodes, attributes or tags, with no ids or ranges of them."""
        return pick(self) if self.local is None else self.placed(pick(self.local))

    def placed(self, found: DataFrame) -> DataFrame:
        """Rows ``found(doc_id, ...)`` of pieces as rows of the documents: lines count from the document's first, branches differ from piece to piece."""
        found = checkpoint(found)
        names = found.columns
        if found.count() <= _BROADCAST:
            found = F.broadcast(found)
        out = self.places.join(found.withColumnRenamed("doc_id", "piece"), "piece")
        if "line" in names:
            out = out.withColumn("line", F.col("line") + F.col("above"))
        if "branch" in names:
            out = out.withColumn("branch", F.transform("branch", lambda x: F.concat(F.col("above").cast("string"), F.lit("."), x)))
        return out.select(*names)

    def without(self, docs: DataFrame) -> Tables:
        """The tables of the other documents than ``docs(doc_id)``."""
        out = object.__new__(Tables)
        out.docs = self.docs.join(docs, "doc_id", "left_anti")
        out.rows = self.rows.join(docs, "doc_id", "left_anti")
        return out

    def _kind(self, kind: str) -> DataFrame:
        return self.rows.where(F.col("kind") == kind)

    @property
    def nodes(self) -> DataFrame:
        return self._kind("node").select(
            "doc_id", "node_id", "parent_id", "pos", "depth", "type", "tag", "raw", "content", "opening", "closing", "control", "line", "column", "range_from", "range_to", "ancestors", "branch"
        )

    @property
    def elements(self) -> DataFrame:
        return self._kind("node").where("type = 'element'").select(
            "doc_id", "node_id", "parent_id", "pos", "depth", "tag", "raw", "closing", "close", "close_raw", "space", "close_space", "attr", "dynamic", "direct_text", "child_tags", "accessible",
            "line", "column", "range_from", "range_to", "ancestors", "branch",
        )

    @property
    def attributes(self) -> DataFrame:
        return self._kind("attr").select("doc_id", "node_id", "pos", "tag", "name", "raw", "value", "quote", "equals", "parts", "name_parts", "line", "column", "ancestors", "branch")

    @property
    def erb(self) -> DataFrame:
        return self._kind("erb").select("doc_id", "node_id", "pos", "opening", "content", "closing", "control", F.col("type").alias("place"), "name", "line", "column", "range_from", "range_to", "ancestors")

    @property
    def errors(self) -> DataFrame:
        return self._kind("error").select("doc_id", "pos", "name", "message", "line", "column")

    @property
    def blocks(self) -> DataFrame:
        return self._kind("node").where("type = 'block'").select("doc_id", "node_id", "control", F.col("name").isNotNull().alias("closed"), F.col("child_tags").alias("branches"), "opening", "content", "line", "column", "ancestors")
