"""Jaccard join of 5-word shingle sets by T-occurrence search.

Two sets x and y with Jaccard similarity of at least 0.8 share at least
T = ceil(4 (|x| + |y|) / 9) shingles.  As in DivideSkip, a set's inverted lists
are divided into L long ones, which are only probed, and short ones, which are
merged and on which a partner must occur T - L times.  L is T - 1, as many as
there can be: one occurrence on a short list makes a candidate.  So each set is posted only under
its shortest lists; lists are put together by a merge sort; candidates on them
are verified by binary probes of one set's shingles in the other's sorted
array.

The length of a list is known from a table of shingle counts over all
documents, hashed into ``2 ** TABLE_BITS`` counters (a fixed size, so it can be
broadcast).  The table only orders lists, rarest first; any order gives exact
results.

A list may be long where many documents are near copies of each other, or share
a passage and little else.  Pairs on a list are therefore not expanded at once:
first each set is compared with its neighbour on the list and with the list's
leader, and components are formed; then only pairs of *different* components
that can still reach T are expanded.  Sets that are equal are one node from the
start.

Definitions: words are runs of anything but ASCII white space, A-Z
lower-cased; fewer than five words form one shingle; null and blank texts have
no shingles and no links.  A row with a null id is kept with its count, links
nothing and has a null component.  Repeated ids and rows give repeated result
rows.  Extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._graph import components, lookup
from tessera.llm._io import Batches, as_bytes, columns
from tessera.llm._text import shingles, word_hashes
from tessera.session import checkpoint, release

TABLE_BITS = 20
#: Bits of the filter by which a scan finds candidates' documents.
FILTER_BITS = 24
_CHUNK_BITS = 12
#: Sets a task remembers as posted.
_POSTED = 500_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    return shingles(word_hashes(text.translate(_LOWER))) if text else np.empty(0, np.uint64)


def node_of(s: np.ndarray) -> int:
    """64-bit id of a set, as a long: sets with equal ids are taken as equal."""
    mixed = (s ^ (s >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    total = int(np.sum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64))
    x = (total * 0xA24BAED4963EE407 + len(s)) & (1 << 64) - 1
    x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


def least_overlap(n: int, m: int) -> int:
    """T: 100 * shared >= 80 * union."""
    return -(-4 * (n + m) // 9)


def _counts(docs: DataFrame) -> Broadcast:
    """Occurrences of shingles over all documents, hashed into a table of fixed size."""
    size = 1 << _CHUNK_BITS

    def count(batches: Batches) -> Batches:
        table = np.zeros(1 << TABLE_BITS, np.int64)
        for b in batches:
            sets = [shingle_set(t) for t in as_bytes(b.column("text"))]
            table += np.bincount((np.concatenate(sets or [np.empty(0, np.uint64)]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table))
        yield from partial(table)

    def partial(table: np.ndarray) -> Batches:
        part = np.minimum(table, (1 << 31) - 1).astype(np.int32).reshape(-1, size)
        at = np.flatnonzero(part.any(axis=1))
        salt = int(np.random.default_rng(int(table.sum())).integers(64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int32()), pa.array(np.full(len(at), salt), pa.int32()), pa.array([part[i].tobytes() for i in at], pa.binary())], names=["chunk", "salt", "counts"]
        )

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)
        for x in rows.column("counts").to_pylist():
            total += np.frombuffer(x, np.int32)
        total = np.minimum(total, (1 << 31) - 1).astype(np.int32)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select("text").mapInArrow(count, "chunk int, salt int, counts binary")
    # summed in two steps, so no task reads more than a share of all partial tables
    parts = parts.groupBy("chunk", "salt").applyInArrow(add, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    table = np.zeros((1 << TABLE_BITS) // size * size, np.int32).reshape(-1, size)
    for r in parts.collect():
        table[r["chunk"]] = np.frombuffer(r["counts"], np.int32)
    return docs.sparkSession.sparkContext.broadcast(table.ravel())


def posted(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The short lists of a set in their order: all but the ceil(0.8 n) - 1 longest."""
    n = len(s)
    keep = n - (4 * n + 4) // 5 + 1
    order = (counts[(s >> np.uint64(64 - TABLE_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32)) | (s & np.uint64(0xFFFFFFFF))
    if keep < n // 2:
        near = np.argpartition(order, keep)[: keep + 1]
        cut = order[near].max()
        near = np.flatnonzero(order <= cut)
        return s[near[np.argsort(order[near], kind="stable")[:keep]]]
    return s[np.argsort(order, kind="stable")[:keep]]


def _postings(docs: DataFrame, counts: Broadcast) -> DataFrame:
    """(shingle, node, at): ``at`` holds the size of the set and the rank of the list, 32 bits each.

    A task posts a set once, however many documents have it: a group of copies
    gives its lists a row for each task at most (or for each ``_POSTED`` sets).
    """

    def run(batches: Batches) -> Batches:
        table = counts.value
        seen: set[int] = set()
        for b in batches:
            lists, nodes, at = [], [], []
            for t in as_bytes(b.column("text")):
                s = shingle_set(t)
                if len(s) and (node := node_of(s)) not in seen:
                    if len(seen) >= _POSTED:
                        seen.clear()
                    seen.add(node)
                    p = posted(s, table)
                    lists.append(p)
                    nodes.append(np.full(len(p), node, np.int64))
                    at.append((len(s) << 32) + np.arange(len(p), dtype=np.int64))
            if lists:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (lists, nodes, at)], names=["shingle", "node", "at"])

    return docs.select("text").mapInArrow(run, "shingle long, node long, at long")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node) of every row, and what it has besides its text."""
    also = [f for f in docs.schema.fields if f.name not in ("doc_id", "text")]

    def run(batches: Batches) -> Batches:
        for b in batches:
            sets = [shingle_set(t) for t in as_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), *(b.column(n) for n in names)],
                names=["doc_id", "n_shingles", "node", *names],
            )

    names = [f.name for f in also]
    return docs.mapInArrow(run, ", ".join(["doc_id long, n_shingles long, node long", *(f"{f.name} {f.dataType.simpleString()}" for f in also)]))


#: Two entries of a list can belong to a link only if, from their ranks on, enough shingles are left on either side.
_VIABLE = "least({x} >> 32, {y} >> 32) * 5 >= greatest({x} >> 32, {y} >> 32) * 4 and least(({x} >> 32) - ({x} & 4294967295L), ({y} >> 32) - ({y} & 4294967295L)) * 9 >= (({x} >> 32) + ({y} >> 32)) * 4"


def viable(x: str, y: str) -> F.Column:
    return F.expr(_VIABLE.replace("{x}", x).replace("{y}", y))


def _bitmap(ids: DataFrame) -> Broadcast:
    """A bitmap of fixed size in which the bits of all ``ids(doc_id)`` are set: a filter that lets some others pass."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(doc_id), 64) as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()  # at most 2 ** (FILTER_BITS - 6) words
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return ids.sparkSession.sparkContext.broadcast(bits)


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose sets reach the similarity, by binary probes.

    Texts are not shuffled: a scan builds the sets of the documents that stand
    for a candidate, which a bitmap of their ids tells from most others.
    """
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    stand = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi")
    bits = _bitmap(stand.select("doc_id"))

    def sets(batches: Batches) -> Batches:
        have = bits.value
        for b in batches:
            h, bit = (b.column(n).to_numpy() for n in ("word", "bit"))
            b = b.filter(pa.array((have[h] >> bit) & 1 == 1))
            found = [shingle_set(t) for t in as_bytes(b.column("text"))]
            found = [s for s in found if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "s"])

    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    made = docs.select(F.shiftright(hashed, 6).alias("word"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("bit"), "text").mapInArrow(sets, "node long, s binary")
    both = pairs.join(made.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(made.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")

    def probe(batches: Batches) -> Batches:
        for b in batches:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(probe, "a long, b long").distinct()


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    shared = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x))
    return shared >= least_overlap(len(x), len(y))


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def link(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, n_shingles, component_id."""
    return grouped(columns(docs, "doc_id", "text")).select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and ``first`` of every row of ``docs(doc_id, text, ...)``, with its further columns.

    ``first`` is the least (doc_id, further columns) of the row's component,
    null without an id or shingles: it tells rows apart where ids repeat.
    """
    also = [n for n in docs.columns if n not in ("doc_id", "text")]
    rows = checkpoint(_rows(docs))
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    counts = _counts(docs)
    # put each list together; lists with one set end here, and so do further copies of a list's first set
    order = Window.partitionBy("shingle").orderBy(F.expr("(at & 4294967295L) / (at >> 32)"), "node")
    lists = (
        _postings(docs, counts)
        .withColumn("leader", F.first(F.struct("node", "at")).over(order))
        .withColumn("last", F.lag(F.struct("node", "at")).over(order))
        .withColumn("next", F.lead("node").over(order))
        .where("leader.node != node or next != node")
    )
    # of leader and neighbour only the node is written, and only where the two can reach T
    partner = [F.when((F.col(f"{x}.node") != F.col("node")) & viable("at", f"{x}.at"), F.col(f"{x}.node")).alias(x) for x in ("leader", "last")]
    lists = checkpoint(lists.select("shingle", "node", "at", *partner))
    first = lists.where("leader is not null").select(*_pair("node", "leader")).unionByName(lists.where("last is not null").select(*_pair("node", "last")))
    first = checkpoint(first.distinct())
    # what only earlier queries read goes before more is written; the postings' shuffle is the largest
    release(docs.sparkSession)
    links = checkpoint(verified(first, docs, rows))
    joined = components(links)
    release(docs.sparkSession)
    # lists that still hold several components; their pairs across components that can reach T
    member = lists.select("shingle", "node", "at").distinct().join(joined, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("leader")
    open_ = member.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("shingle")
    member = checkpoint(member.join(open_, "shingle", "left_semi"))
    del lists, open_
    other = member.select("shingle", F.col("node").alias("node2"), F.col("at").alias("at2"), F.col("component").alias("component2"))
    more = member.join(other, "shingle").where("component < component2").where(viable("at", "at2")).select(*_pair("node", "node2")).distinct().join(first, ["a", "b"], "left_anti")
    more = checkpoint(more)
    del member, other
    release(docs.sparkSession)
    if more.take(1):
        links = links.unionByName(verified(more, docs, rows))
        joined = components(links)
    # names: the smallest id of each component
    low = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", *also)).alias("low"))
    named = low.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("low").alias("first"))
    by_node = lookup(named.select("node", "component"), "component", least).select("node", "first")
    out = lookup(rows, "node", by_node)
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNotNull() & F.col("doc_id").isNotNull(), F.col("first")).alias("first"), *also)
