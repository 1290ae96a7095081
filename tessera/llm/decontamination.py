"""Benchmark decontamination with a generalised suffix automaton over item words.

All benchmark items are inserted into one suffix automaton whose alphabet is
word ids.  Training words are streamed through it; at each word the automaton
gives the length of the longest item passage that ends there.  A passage of 13
words or more, or a whole item of fewer words, is a hit and its words are
marked.  ``clean`` drops the documents whose marked words exceed the coverage
limit; ``strip`` does so too, and cuts the marked spans out of all others.

Definitions: words are maximal runs of digits, a-z (A-Z lower-cased) and any
non-ASCII characters.  Null or empty texts have no words, no hits and are never
contaminated; null or empty items and items with a null id match nothing;
repeated items and items with equal texts all count; repeated documents give
repeated rows; extra columns are ignored; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from tessera.llm._io import Batches, arrow_schema, as_bytes, batch, columns, packed, unpacked
from tessera.llm._text import WORD_TABLE

WINDOW = 13
#: Words of benchmark items in one automaton.  A larger benchmark is dealt into several, run one after the other.
AUTOMATON_WORDS = 400_000
_RUN = re.compile(rb"[^ ]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_TABLE).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences, with the items behind each state.

    Items of equal words are one sequence with several ids.
    """

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        by_words: dict[tuple[bytes, ...], list[int]] = {}
        for item, seq in items:
            by_words.setdefault(tuple(seq), []).append(item)
        self.named = list(by_words.values())
        items = [(k, list(seq)) for k, seq in enumerate(by_words)]
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.whole: dict[int, list[int]] = {}
        ends: dict[int, set[int]] = {}
        self.least = window
        for item, seq in items:
            if not seq:
                continue
            self.least = min(self.least, len(seq))
            last = 0
            for w in seq:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
        for item, seq in items:
            state = 0
            for w in seq:
                state = self.next[state][self.ids[w]]
                ends.setdefault(state, set()).add(item)
            if 0 < len(seq) < window:
                self.whole.setdefault(state, []).append(item)
        self._owners(ends)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(c)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._split(last, c, known)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _owners(self, ends: dict[int, set[int]]) -> None:
        """Items of each state that holds a full window: its own and those of all longer passages that end alike."""
        self.owners: list[set[int]] = [set() for _ in self.next]
        for s, items in ends.items():
            self.owners[s] |= items
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.length[up] >= self.window:
                self.owners[up] |= self.owners[s]
        # the nearest suffix state, itself included, at which a short item is complete
        self.short = [-1] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.short[s] = s if s in self.whole else self.short[self.link[s]]

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans ``[from, to)``, disjoint and in order, and the items found."""
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in seq), np.int64, len(seq))
        edge = np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0])))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if b - a >= self.least:
                self._stream(ids[a:b].tolist(), a, spans, found)
        return _merged(spans), {item for k in found for item in self.named[k]}

    def _stream(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[int]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = run = 0
        seen: set[int] = set()
        for i, c in enumerate(ids, base + 1):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            state = nxt[state].get(c, 0)
            run = run + 1 if state else 0
            if run >= window:
                spans.append((i - run, i))
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                if s not in seen:
                    seen.add(s)
                    found |= self.owners[s]
            s = self.short[state]
            while s > 0:
                if length[s] <= run:
                    spans.append((i - length[s], i))
                    found.update(self.whole[s])
                s = self.short[link[s]]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _dealt(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in groups of about ``limit`` words, without those that have no words; the driver holds one group at a time, the first may be empty."""
    group: list[tuple[int, list[bytes]]] = []
    total = 0
    for r in columns(benchmark, "item_id", "text").where("item_id is not null and text is not null").dropDuplicates().toLocalIterator():
        seq = words(r["text"].encode())
        if group and total + len(seq) > limit:
            yield group
            group, total = [], 0
        if seq:
            group.append((r["item_id"], seq))
            total += len(seq)
    yield group


_STEP = arrow_schema(n_words=pa.int64(), spans=pa.list_(pa.int32()), items=pa.list_(pa.int64()))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, flat hit ``spans`` (from, to, from, to, ... in words) and the ``items`` found.

    One scan without a shuffle.  The automaton is built once and broadcast: its
    size is bounded by ``automaton_words``; further groups of items run as
    further steps over the same rows, and spans are united.
    """
    spark = docs.sparkSession
    keep = [f for f in docs.schema.fields if f.name not in _STEP.names]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in keep])
    schema = StructType([*keep]).add("n_words", LongType()).add("spans", ArrayType(IntegerType())).add("items", ArrayType(LongType()))
    for k, group in enumerate(_dealt(benchmark, automaton_words)):
        shared = spark.sparkContext.broadcast(Automaton(group, window))

        def run(batches: Batches, shared=shared, first=k == 0) -> Batches:
            machine = shared.value
            for b in batches:
                n, spans, items = [], [], []
                before = [] if first else zip(b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True)
                for text, old in zip(as_bytes(b.column("text")), before or [None] * b.num_rows, strict=True):
                    seq = words(text)
                    hit, found = machine.scan(seq)
                    if old:
                        hit = _merged(hit + list(zip(old[0][::2], old[0][1::2], strict=True)))
                        found |= set(old[1])
                    n.append(len(seq))
                    spans.append([x for pair in hit for x in pair])
                    items.append(sorted(found))
                rest = [b.column(f.name) for f in keep]
                made = batch(_STEP, n_words=n, spans=spans, items=items)
                yield pa.RecordBatch.from_arrays([*rest, *made.columns], names=[*(f.name for f in keep), *_STEP.names])

        docs = docs.mapInArrow(run, schema)
    return docs


def _n_hit() -> F.Column:
    return F.expr("cast(aggregate(sequence(0, size(spans)), 0L, (n, i) -> n + case when i < size(spans) then (case when i % 2 = 0 then -spans[i] else spans[i] end) else 0 end) as long)")


def judged(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """``find`` with ``n_hit`` and ``contaminated``: some words hit, and ``share * n_hit >= n_words``."""
    return (
        find(docs, benchmark, **options)
        .withColumn("n_hit", _n_hit())
        .withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    )


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Contract rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return judged(columns(docs, "doc_id", "text"), benchmark, **options).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names).cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their own columns, whatever their names."""
    return unpacked(judged(packed(docs, "text"), benchmark, **options).where(~F.col("contaminated")), docs.columns)


def cut(text: bytes, spans: list[int]) -> bytes:
    """``text`` without the words of the flat ``spans``, and without what lies between the words of a span."""
    found = [m.span() for m in _RUN.finditer(text.translate(WORD_TABLE))]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : found[a][0]])
        at = found[b - 1][1]
    return b"".join([*out, text[at:]])


def strip(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``clean``, and the hit spans cut out of the texts of what remains; other columns stay as they are."""
    rows = judged(packed(docs, "text"), benchmark, **options).where(~F.col("contaminated")).select("row", "text", "spans")
    schema = rows.select("row", "text").schema

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = [cut(t, s).decode() if s else None if t is None else t.decode() for t, s in zip(as_bytes(b.column("text")), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    at = docs.columns.index("text")
    return unpacked(rows.mapInArrow(run, schema).withColumn("row", F.col("row").withField(f"c{at}", F.col("text"))), docs.columns)
