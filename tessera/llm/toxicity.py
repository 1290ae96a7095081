"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its word unigrams, bigrams and
skip-grams (one or two words skipped); a word is also seen through its leading
letters, so inflected and compounded forms share a feature.  FTRL-proximal
keeps a rate per coordinate and its L1 term sets most weights to zero, so the
model is a short sorted list of buckets and weights whose size is bounded by
``2 ** BITS``, whatever the corpus.

Texts that are null or empty have no features and score the bias.  Ties and
repeated rows score alike; ids may repeat.  Without labelled rows, or with one
class only, the model is the smoothed class share.  An id that is marked both
ways is taken as toxic; rows equal in id and text are learned once.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.llm._io import Batches, as_bytes, columns
from tessera.llm._text import WORD_TABLE, mix, stem_hashes

BITS = 20
#: Words and their stems hash below this bucket, n-grams and skip-grams above.
HALF = 1 << (BITS - 1)
#: Labelled rows used for training, at most about this many (chosen by a hash of id and text).
MAX_LABELLED = 8000
EPOCHS = 3
_STEMS = (6, 8)


def _hashed(text: bytes | None) -> list[np.ndarray]:
    """Buckets of a text, with repeats."""
    if not text:
        return [np.empty(0, np.int32)]
    plain = (text if text.isascii() else text.decode().lower().encode()).translate(WORD_TABLE)
    h, *stems = stem_hashes(plain, _STEMS)
    parts = [_bucket(x, 0) for x in (h, *stems)]
    for gap, salt in ((1, 0x51), (2, 0x52), (3, 0x53)):
        if len(h) > gap:
            parts.append(_bucket(mix(h[:-gap] * np.uint64(0xD6E8FEB86659FD93) + h[gap:] + np.uint64(salt)), HALF))
    return parts


def features(text: bytes | None) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    return np.unique(np.concatenate(_hashed(text)))


def _bucket(h: np.ndarray, base: int) -> np.ndarray:
    return (h >> np.uint64(65 - BITS)).astype(np.int32) + np.int32(base)


def values(at: np.ndarray) -> np.ndarray:
    """Value of a feature by its bucket: words and stems 1, n-grams and skip-grams half."""
    return np.where((at >= HALF) & (at < 1 << BITS), 0.5, 1.0)


@dataclass
class Ftrl:
    """FTRL-proximal with per-coordinate rates; coordinate ``2 ** BITS`` is the bias."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    z: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS) + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        bias = at == 1 << BITS
        shrunk = np.where(bias, z, np.sign(z) * np.maximum(np.abs(z) - self.l1, 0))
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int, importance: float = 1.0) -> None:
        at = np.append(at, np.int32(1 << BITS))
        w, v = self.weights(at), values(at)
        g = importance * (_sigmoid(float(w @ v)) - label) * v
        n = self.n[at]
        grown = n + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[at] = grown

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """Dense float32 weights are rebuilt from these non-zero buckets."""
        at = np.flatnonzero(np.abs(self.z) > 0)
        w = self.weights(at)
        return at[w != 0].astype(np.int32), w[w != 0].astype(np.float32)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


@dataclass
class Model:
    at: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[self.at] = self.weight * values(self.at)
        return w


def _train(rows: list[tuple[np.ndarray, int]]) -> Model:
    model = Ftrl()
    share = sum(y for _, y in rows) / len(rows)
    up = min(4.0, math.sqrt((1 - share) / share)) if 0 < share < 1 else 1.0
    for _ in range(EPOCHS):
        for at, y in rows:
            model.learn(at, y, up if y else 1.0)
    return Model(*model.sparse())


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from the rows of ``docs(doc_id, text)`` that ``labels(doc_id, toxic)`` marks.

    The labelled rows are bounded by ``max_labelled``: a hash of id and text
    admits the share of them that meets the bound, however often an id occurs.
    They are hashed where they lie and one task learns from them in the order
    of that hash.  A very long text has at most ``2 ** BITS`` features.
    """
    marks = columns(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = columns(docs, "doc_id", "text").withColumn("turn", F.xxhash64(F.lit(77), "doc_id", "text")).join(marks, "doc_id").select("turn", "toxic", "text")
    n = marked.select("turn").distinct().count()
    if n > max_labelled:
        marked = marked.where(F.pmod("turn", F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))

    def hashed(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("turn"), b.column("toxic").cast(pa.int32()), pa.array([features(t).tobytes() for t in as_bytes(b.column("text"))], pa.binary())],
                names=["turn", "toxic", "at"],
            )

    def learn(batches: Batches) -> Batches:
        rows = [(np.frombuffer(a, np.int32), int(y > 0)) for b in batches for y, a in zip(b.column("toxic").to_pylist(), b.column("at").to_pylist(), strict=True)]
        if rows:
            m = _train(rows)
            yield pa.RecordBatch.from_arrays([pa.array([m.at.tobytes()], pa.binary()), pa.array([m.weight.tobytes()], pa.binary())], names=["at", "weight"])

    found = (
        marked.dropDuplicates(["turn"])
        .mapInArrow(hashed, "turn long, toxic int, at binary")
        .repartition(1)
        .sortWithinPartitions("turn", "toxic")
        .mapInArrow(learn, "at binary, weight binary")
        .collect()
    )
    if not found:
        return Model(np.empty(0, np.int32), np.empty(0, np.float32))
    return Model(np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["weight"], np.float32))


def _total(w: np.ndarray, text: bytes | None) -> float:
    """Sum of the weights of the distinct features; few weights are not zero, so those are sorted alone."""
    at = np.concatenate(_hashed(text))
    return float(w[np.unique(at[w[at] != 0])].sum(dtype=np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs(doc_id, text)``: one scan, no shuffle."""
    return with_score(columns(docs, "doc_id", "text"), model).select("doc_id", "score")


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text`` as a further column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        w = shared.value.dense()
        bias = float(w[1 << BITS])
        for b in batches:
            s = [_sigmoid(bias + _total(w, t)) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def held_out(remainder: int, modulus: int) -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Contract rows: doc_id, held_out, score, predicted; rows of remainder 1 of 3 are never learned from."""
    docs = columns(docs, "doc_id", "text")
    model = fit(docs.where(~held_out(1, 3)), labels)
    return score(docs, model).select(
        "doc_id", held_out(1, 3).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )

