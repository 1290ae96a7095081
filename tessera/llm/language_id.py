"""Language identification by hierarchical discrimination.

The language family of a text is predicted first; within the family, one linear
support vector machine for each pair of languages votes.  Features are the
hashed character unigrams, bigrams and trigrams of the whole text, lower-cased,
with everything but letters taken as one blank, as shares of their order's
total.  A machine is trained by dual coordinate descent on the L2-regularised
hinge loss.

Texts that are null or hold no letter are ``und`` with score 0.  Without any
labelled text every text is ``und``; with one language only, it is predicted
with score 1.  Repeated rows and ids are rows of their own; ties between votes
go to the larger sum of margins, then to the language first in order; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._io import Batches, arrow_schema, batch, columns
from tessera.llm._text import mix

BITS = 11
ORDERS = (1, 2, 3)
#: Training texts per language, at most about this many, chosen by a hash of id and text; equal texts of a language count once.
MAX_PER_LANGUAGE = 1000
#: And of all languages together, which bounds the driver's memory.
MAX_TEXTS = 4000
#: Characters of a text handled at a time, which bounds memory; n-grams run across the pieces.
PIECE = 1 << 18

#: Language families by ISO 639 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca co es fr gl it la lmo oc pt rm ro sc scn",
    "slavic": "be bg bs cs cu dsb hr hsb mk pl ru sk sl sr szl uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba crh kk ky tk tr tt ug uz",
    "indo-iranian": "as bn ckb fa gu hi ku mr ne or pa ps sa sd si tg ur",
    "semitic": "am ar he mt ti",
    "dravidian": "kn ml ta te",
    "sino-tibetan": "bo my yue zh",
    "austronesian": "ceb haw id jv mg mi ms su tl",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    """The family of a language; a language not listed is a family of its own."""
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    return out


_table: list[np.ndarray] = []


def _symbols(text: str, piece: int) -> Iterator[np.ndarray]:
    """Letters of a text, lower-cased, and one 0 for what stands around and between them, in pieces."""
    if not _table:
        _table.append(_letters())
    text = text.lower()
    last = 1  # a 0 begins the stream
    for i in range(0, max(len(text), 1), piece):
        a = _table[0][np.frombuffer(text[i : i + piece].encode("utf-32-le", "surrogatepass"), np.uint32)]
        if i == 0:
            a = np.concatenate((np.zeros(1, np.uint32), a))
        if i + piece >= len(text):
            a = np.concatenate((a, np.zeros(1, np.uint32)))
        before = np.concatenate((np.array([last], np.uint32), a[:-1]))
        last = int(a[-1])
        yield a[(a != 0) | (before != 0)].astype(np.uint64)


def vector(text: str | None, piece: int = PIECE) -> np.ndarray | None:
    """Share of each bucket within its order; None without a letter.  ``piece`` bounds memory and changes nothing."""
    out, seen = np.zeros((len(ORDERS), 1 << BITS), np.float64), False
    tail = np.empty(0, np.uint64)
    for a in _symbols(text or "", piece):
        seen = seen or bool(a.any())
        a = np.concatenate((tail, a))
        for k, n in enumerate(ORDERS):
            # n-grams that end in a symbol of this piece
            s = a[max(0, len(tail) - n + 1) :]
            if len(s) >= n:
                key = np.full(len(s) - n + 1, n, np.uint64)
                for j in range(n):
                    key = (key << np.uint64(21)) ^ s[j : len(s) - n + 1 + j] ^ (key >> np.uint64(43))
                out[k] += np.bincount((mix(key) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
        tail = a[max(0, len(a) - max(ORDERS) + 1) :]
    return (out / np.maximum(out.sum(axis=1, keepdims=True), 1)).ravel() if seen else None


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, passes: int = 12) -> np.ndarray:
    """Weights (the last one is the bias) of a linear SVM by dual coordinate descent; rows of ``x`` are scaled to length 1."""
    x = np.hstack([x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), np.full((len(x), 1), 0.3)], dtype=np.float32, casting="same_kind")
    up = {s: c * len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    square = (x * x).sum(axis=1)
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(y)):
            step = np.clip(alpha[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0, up[int(y[i])])
            if step != alpha[i]:
                w += (step - alpha[i]) * y[i] * x[i]
                alpha[i] = step
    w[-1] *= 0.3
    return w


@dataclass
class Model:
    """``pairs`` of (first, second, weights): families first, then languages of each family."""

    languages: list[str]
    families: list[str] = field(default_factory=list)
    top: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    within: dict[str, list[tuple[int, int, np.ndarray]]] = field(default_factory=dict)

    def predict(self, v: np.ndarray | None) -> tuple[str, float]:
        if v is None or not self.languages:
            return "und", 0.0
        v = v / max(np.linalg.norm(v), 1e-12)
        f, sure = _vote(v, self.top, list(range(len(self.families))))
        family = self.families[f]
        inside = [i for i, x in enumerate(self.languages) if family_of(x) == family]
        lang, surer = _vote(v, self.within[family], inside)
        return self.languages[lang], sure * surer


def _vote(v: np.ndarray, pairs: list[tuple[int, int, np.ndarray]], names: list[int]) -> tuple[int, float]:
    if len(names) == 1:
        return names[0], 1.0
    votes, margins = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
    for i, j, w in pairs:
        m = float(w[:-1] @ v + w[-1])
        votes[i if m > 0 else j] += 1
        margins[i] += m
        margins[j] -= m
    best = max(names, key=lambda k: (votes[k], margins[k], -k))
    worst = min((abs(float(w[:-1] @ v + w[-1])) for i, j, w in pairs if best in (i, j)), default=0.0)
    return best, 1 / (1 + np.exp(-3 * worst)) if votes[best] == len(names) - 1 else 0.5


def _pairs(x: np.ndarray, y: np.ndarray, names: list[int]) -> list[tuple[int, int, np.ndarray]]:
    out = []
    for n, i in enumerate(names):
        for j in names[n + 1 :]:
            at = (y == i) | (y == j)
            out.append((i, j, svm(x[at], np.where(y[at] == i, 1.0, -1.0))))
    return out


def train(rows: list[tuple[str, np.ndarray]]) -> Model:
    languages = sorted({lang for lang, _ in rows})
    model = Model(languages, sorted({family_of(x) for x in languages}))
    if not rows:
        return model
    x = np.stack([v for _, v in rows])
    lang = np.array([languages.index(n) for n, _ in rows])
    fam = np.array([model.families.index(family_of(languages[k])) for k in lang])
    model.top = _pairs(x, fam, list(range(len(model.families))))
    for k, f in enumerate(model.families):
        at = fam == k
        model.within[f] = _pairs(x[at], lang[at], sorted(set(lang[at].tolist())))
    return model


def fit(docs: DataFrame, most: int = MAX_PER_LANGUAGE) -> Model:
    """Learn from ``docs(doc_id, text, lang)``; about ``most`` texts of each language, whole, chosen by a hash of id and text.

    Only sparse feature vectors of the chosen texts reach the driver, and a row
    for each language: the machines, and so the model that is broadcast, grow
    with the square of the languages of a family, which labels bound.
    """
    usable = columns(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null").withColumn("turn", F.xxhash64(F.lit(11), "doc_id", "text"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Model([])
    most = min(most, MAX_TEXTS // len(sizes) + 1)
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, int(min(1.0, most / n) * (1 << 30)))])
    chosen = usable.where(F.pmod("turn", F.lit(1 << 30)) < share[F.col("lang")]).dropDuplicates(["lang", "turn"])

    def run(batches: Batches) -> Batches:
        for b in batches:
            lang, at, value = [], [], []
            for name, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                v = vector(text)
                if v is not None:
                    i = np.flatnonzero(v)
                    lang.append(name)
                    at.append(i.astype(np.int32).tobytes())
                    value.append(v[i].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["lang", "at", "value"])

    rows = []
    for r in chosen.select("lang", "text").mapInArrow(run, "lang string, at binary, value binary").collect():
        v = np.zeros(len(ORDERS) << BITS, np.float32)
        v[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["value"], np.float32)
        rows.append((r["lang"], v))
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    return train(rows)


SCHEMA = "doc_id long, lang_pred string, score double"
_ARROW = arrow_schema(doc_id=pa.int64(), lang_pred=pa.string(), score=pa.float64())


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` for each row of ``docs(doc_id, text)``: one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Batches) -> Batches:
        m = shared.value
        for b in batches:
            got = [m.predict(vector(t)) for t in b.column("text").to_pylist()]
            yield batch(_ARROW, doc_id=b.column("doc_id"), lang_pred=[x for x, _ in got], score=[float(s) for _, s in got])

    return columns(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, lang_pred, score; rows of remainder 0 of 5 are never learned from."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
