"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A vector is rotated by three rounds of random signs and a fast Hadamard
transform; its cross-polytope hash is the coordinate of largest magnitude with
its sign.  Some such hashes and the label make a bucket of one of several
tables.  A vector lies in its own bucket and probes the next best ones, found
by the smallest loss of magnitude.  Two vectors meet where one lies in a bucket
that the other lies in or probes; every meeting is verified by the cosine in
double precision, and counted once, in the first bucket in which they meet.

The number of hashes grows with the logarithm of the largest label's vectors,
so that unrelated vectors share few buckets at any size; the number of tables
follows from it: as many as let ``RECALL`` of random pairs at the limit itself
meet, by a seeded trial on the driver.

Candidates are found on ids and codes alone.  Vectors join the rows of buckets
with company, and a task compares whole buckets after one sort.  A bucket with
more than ``BLOCK`` vectors is cut into blocks, and pairs of blocks are compared
like buckets.  What leaves a bucket is a row for each vector in it, with the
number of its links there and the least vector it is connected with, never the
pairs.

Equal vectors of a label are one node with a count from the start, so groups of
exact copies are never paired; rows find their node by 128 bits of hash.

Vectors with a null label, and vectors that are null, empty, zero, or hold a null
or non-finite component, link with nothing and are their own component.
Vectors of different lengths never link.  A pair whose cosine is the limit itself
links.  Repeated ids are vectors of their own and share their smallest id's
component; a null id links nothing; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm._graph import components, lookup
from tessera.llm._io import Batches, columns
from tessera.session import checkpoint

PROBES = 3
#: Share of random pairs at the limit that must meet in some table.
RECALL = 0.995
#: Vectors of a bucket compared in one task; fuller buckets are cut into blocks of about this many.
BLOCK = 4096
#: Rows a task gathers before it compares the buckets among them.
_GATHER = 16384
_SEED = 20240229


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def width_of(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


@dataclass(frozen=True)
class Tables:
    hashes: int
    tables: int


def choose(d: int, n: int, least: float) -> Tables:
    """Hashes for ``n`` vectors of ``d`` components, and the tables that make up for them."""
    hashes = max(1, math.ceil(math.log(max(n, 2)) / math.log(2 * width_of(d))))
    r = np.random.default_rng(_SEED + d)
    x, z = r.normal(size=(2, 600, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    tried = Tables(hashes, 4)
    a, b = codes(x, tried), codes(least * x + math.sqrt(max(0.0, 1 - least * least)) * z, tried)
    met = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
    p = min(max(float(met.mean()), 1e-3), 0.999)
    return Tables(hashes, max(2, math.ceil(math.log(1 - RECALL) / math.log(1 - p))))


def codes(x: np.ndarray, made: Tables) -> np.ndarray:
    """Bucket codes of the rows of ``x``: ``[row, table, probe]``; probe 0 is the vector's own bucket."""
    n, d = x.shape
    width = width_of(d)
    k = min(PROBES, width)
    padded = np.zeros((n, width))
    padded[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((n, made.tables, PROBES), np.int64)
    rows = np.arange(n)[:, None]
    for t in range(made.tables):
        signs = np.random.default_rng((_SEED, width, t)).choice([-1.0, 1.0], (made.hashes, 3, width))
        code, total = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for h in range(made.hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[h, r])
            size = np.abs(y)
            top = np.argpartition(-size, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.lexsort((top, -size[rows, top]), axis=1), axis=1)
            best = 2 * top + (y[rows, top] < 0)
            loss = (size[rows, top[:, :1]] - size[rows, top]) ** 2
            # the best combinations so far with the alternatives of one more hash, by total loss
            total = (total[:, :, None] + loss[:, None, :]).reshape(n, -1)
            # codes of many hashes wrap around: two buckets with one code are one, which only adds comparisons
            code = (code[:, :, None] * np.int64(2 * width + 1) + best[:, None, :] + 1).reshape(n, -1)
            order = np.argsort(total, axis=1, kind="stable")[:, :PROBES]
            code, total = np.take_along_axis(code, order, axis=1), np.take_along_axis(total, order, axis=1)
        out[:, t, : code.shape[1]] = code
        out[:, t, code.shape[1] :] = code[:, :1]
    return out * np.int64(made.tables) + np.arange(made.tables)[None, :, None]


def valid(v: list | None) -> bool:
    return bool(v) and None not in v and bool(np.isfinite(a := np.array(v, np.float64)).all()) and bool(a.any())


def _packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vec): ``vec`` holds the numbers of a usable vector, as doubles if they are no floats, and is null for others; -0 is 0."""
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64

    def run(batches: Batches) -> Batches:
        for b in batches:
            v = [(np.array(x, kind) + kind(0)).tobytes() if valid(x) else None for x in b.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(v, pa.binary())], names=["vec_id", "label", "vec"])

    return vectors.mapInArrow(run, "vec_id long, label string, vec binary")


def _matrix(raw: list[bytes], kind: type) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(nodes: DataFrame, kind: type, made: dict[int, Tables]) -> DataFrame:
    """(node, label, copies, vec, width, codes): codes in the order of tables, own bucket first; a probe that repeats another is null."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            raw = b.column("vec").to_pylist()
            lengths = np.array([len(r) for r in raw])
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                c = codes(_matrix([raw[i] for i in at], kind), made[int(size)])
                again = np.zeros(c.shape, bool)
                for p in range(1, PROBES):
                    again[:, :, p] = (c[:, :, :p] == c[:, :, p : p + 1]).any(axis=2)
                n, width = len(at), c.shape[1] * PROBES
                flat = pa.array(c.ravel(), pa.int64(), mask=again.ravel())
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(x) for x in ("node", "label", "copies", "vec")), pa.array(np.full(n, size), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), flat)],
                    names=["node", "label", "copies", "vec", "width", "codes"],
                )

    return nodes.select("node", "label", "copies", "vec").mapInArrow(run, "node long, label string, copies long, vec binary, width int, codes array<long>")


def _meetings(coded: DataFrame) -> DataFrame:
    """A row for each block of a bucket with company that a vector must be compared in."""
    key = ["label", "width", "bucket"]
    placed = coded.select("node", "label", "width", F.posexplode("codes").alias("at", "bucket")).where("bucket is not null")
    placed = placed.withColumn("lies", F.col("at") % PROBES == 0).drop("at")
    full = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("lies").alias("own")).where("n > 1 and own").select(*key, F.expr(f"cast(ceil(n / {BLOCK}) as int)").alias("blocks"))
    # block i of a bucket meets blocks i, i + 1, ...: a vector of block i goes to the groups (i, j) and (j, i)
    dealt = placed.join(full, key).withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("meets", F.explode(F.expr("sequence(0, blocks - 1)")))
    first, second = F.least("block", "meets"), F.greatest("block", "meets")
    return dealt.select(F.xxhash64(*key, first, second).alias("group"), (first == F.col("block")).alias("left"), (second == F.col("block")).alias("right"), "bucket", "lies", "node")


def links(coded: DataFrame, kind: type, least: float = 0.98) -> DataFrame:
    """(node, n, root): for a vector with links in a bucket, how many vectors it links with there first, and the least node it is connected with."""
    rows = _meetings(coded).join(coded, "node")
    group = ["group", "label", "width", "bucket"]
    rows = rows.select(*group, "left", "right", "lies", "node", "copies", "vec", "codes").repartition("group").sortWithinPartitions(*group)

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= _GATHER:
                t = pa.Table.from_batches(held).combine_chunks()
                edge = _edges(t)
                if len(edge):
                    yield from compare(t.slice(0, int(edge[-1])), edge[:-1])
                    t = t.slice(int(edge[-1]))
                held, size = t.to_batches(), 0 if len(edge) else size
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from compare(t, _edges(t))

    def compare(t: pa.Table, edge: np.ndarray) -> Batches:
        start = np.concatenate(([0], edge))
        end = np.concatenate((edge, [t.num_rows]))
        width = t.column("width").to_numpy()
        for w in np.unique(width[start]):
            mine = width[start] == w
            at = np.concatenate([np.arange(a, b) for a, b in zip(start[mine], end[mine], strict=True)])
            yield from alike(t.take(pa.array(at)), end[mine] - start[mine])

    def alike(t: pa.Table, sizes: np.ndarray) -> Batches:
        x = _matrix(t.column("vec").to_pylist(), kind)
        node, copies, bucket, lies, left, right = (t.column(n).to_numpy() for n in ("node", "copies", "bucket", "lies", "left", "right"))
        c = t.column("codes").combine_chunks().flatten()
        code = c.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).reshape(len(x), -1, PROBES)
        starts = np.cumsum(sizes) - sizes
        found = []
        for i, j in _pairs(starts, sizes, left, right, x, least):
            keep = (lies[i] | lies[j]) & (np.einsum("ij,ij->i", x[i], x[j]) >= least)
            i, j = i[keep], j[keep]
            keep = _first_meeting(code, i, j) == bucket[i]
            found.append((i[keep], j[keep]))
        i, j = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        if not len(i):
            return
        n = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        root = _roots(i, j, node)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(n[at].astype(np.int64)), pa.array(root[at])], names=["node", "n", "root"])

    return rows.mapInArrow(run, "node long, n long, root long")


def _edges(t: pa.Table) -> np.ndarray:
    """Rows at which a new group begins, the first row left out."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for name in ("group", "bucket", "width"):
        v = t.column(name).to_numpy()
        new |= v[1:] != v[:-1]
    label = t.column("label").combine_chunks().dictionary_encode()
    v = label.indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new | (v[1:] != v[:-1])) + 1


def _pairs(starts: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, x: np.ndarray, least: float):
    """Row pairs of the same group to verify: all pairs of small groups, near pairs of large ones."""
    step = max(1, (1 << 22) // x.shape[1])
    for s in np.unique(sizes):
        if s < 2:
            continue
        at = starts[sizes == s]
        if s <= 64:
            p, q = np.triu_indices(s, 1)
            for k in range(0, len(at), max(1, step // len(p))):
                some = at[k : k + max(1, step // len(p)), None]
                i, j = (some + p).ravel(), (some + q).ravel()
                ok = (left[i] & right[j]) | (right[i] & left[j])
                yield i[ok], j[ok]
            continue
        for a in at:
            one, two = a + np.flatnonzero(left[a : a + s]), a + np.flatnonzero(right[a : a + s])
            same = len(one) == s and len(two) == s
            for k in range(0, len(one), 512):
                part = one[k : k + 512]
                near = np.argwhere(x[part] @ x[two].T >= least - 1e-9)
                i, j = part[near[:, 0]], two[near[:, 1]]
                ok = i < j if same else i != j
                yield i[ok], j[ok]


def _first_meeting(code: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first bucket, by table and then by code, in which one of two vectors lies and the other lies or probes."""
    far = np.iinfo(np.int64).max
    out = np.full(len(i), far)
    for t in range(code.shape[1]):
        todo = np.flatnonzero(out == far)
        if not len(todo):
            break
        x, y = code[i[todo], t], code[j[todo], t]
        a = np.where((x[:, :1] == y).any(axis=1), x[:, 0], far)
        b = np.where((y[:, :1] == x).any(axis=1), y[:, 0], far)
        out[todo] = np.minimum(a, b)
    return out


def _roots(i: np.ndarray, j: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The least node connected with each row by the pairs (i, j), by label propagation with pointer jumping."""
    rank = np.empty(len(node), np.int64)
    rank[np.argsort(node, kind="stable")] = np.arange(len(node))
    row = np.argsort(rank)
    best = rank.copy()
    while True:
        before = best.copy()
        low = np.minimum(best[i], best[j])
        np.minimum.at(best, i, low)
        np.minimum.at(best, j, low)
        best = np.minimum(best, best[row[best]])
        if (best == before).all():
            return node[row[best]]


def _key(label: Column, vec: Column) -> list[Column]:
    return [F.xxhash64(label, vec).alias("key"), F.xxhash64(F.lit(1), vec, label).alias("key2")]


def dedup(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """Contract rows: vec_id, n_links, component_id, kept."""
    vectors = columns(vectors, "vec_id", "embedding", "label").withColumn("label", F.col("label").cast("string"))
    kind = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    usable = (F.col("label").isNotNull()) & F.col("vec").isNotNull() & F.col("vec_id").isNotNull()
    rows = checkpoint(_packed(vectors).withColumns(dict(zip(("key", "key2"), (F.when(usable, k) for k in _key(F.col("label"), F.col("vec"))), strict=True))))
    nodes = rows.where(usable).groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    # numbers of written rows: they stay as they are, whoever reads them
    nodes = checkpoint(nodes).withColumn("node", F.monotonically_increasing_id())
    # one row for each length of vectors
    sizes = nodes.groupBy("label", F.octet_length("vec").alias("width")).agg(F.count(F.lit(1)).alias("n")).groupBy("width").agg(F.max("n").alias("n")).collect()
    made = {r["width"]: choose(r["width"] // np.dtype(kind).itemsize, r["n"], least) for r in sizes}
    coded = checkpoint(_coded(nodes, kind, made))
    found = checkpoint(links(coded, kind, least))
    degree = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(degree, "node", "left").join(joined, "node", "left").select(
        *_key(F.col("label"), F.col("vec")), "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")
    )
    named = checkpoint(named)
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = lookup(named, ["component"], first).select("key", "key2", "n_links", "component_id")
    out = lookup(rows.select("vec_id", "key", "key2"), ["key", "key2"], known)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
