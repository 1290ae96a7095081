"""Tree differences of template pairs as rows of operations."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.parser import Item, Options, Parser
from tessera.session import checkpoint

LCS_LIMIT = 256
#: Entries of a path; operations deeper down have the path of the element at that depth.
MAX_DEPTH = 64
#: Ids of pairs that differ without an operation are broadcast up to this many.
BROADCAST_PAIRS = 1_000_000
SCHEMA = "pair_id long, op_index int, type string, path string, old_index int, new_index int, old_value string, new_value string"


def tree_of(source: str | None) -> Item:
    root = Item("document", 1, 0, 0)
    root.children = Parser(source or "", Options(strict=False)).tree()
    return root


def kids(x: Item) -> list[Item]:
    return [c for part in (x.children, *x.branches) for c in part if not (c.kind == "text" and not c.text.strip() and x.tag not in ("pre", "script", "style", "textarea"))]


class Hashes:
    """Merkle hashes of nodes: kind, tokens and children, without positions."""

    def __init__(self):
        self.known: dict[int, str] = {}

    def __call__(self, x: Item) -> str:
        todo = [x]
        while todo:
            n = todo[-1]
            if id(n) in self.known:
                todo.pop()
                continue
            open_ = [c for c in kids(n) if id(c) not in self.known]
            if open_:
                todo += open_
                continue
            own = [n.kind, n.raw, n.text if n.kind != "element" else "", n.opening, n.closing, n.close_raw]
            own += [f"{a.raw}={a.quote}{''.join(p.opening + p.text for p in a.parts)}" for a in n.attrs]
            self.known[id(n)] = hashlib.blake2b("\0".join(own + [self.known[id(c)] for c in kids(n)]).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
            todo.pop()
        return self.known[id(x)]


def _attrs(x: Item) -> dict[str, str]:
    return {a.raw: "".join(p.opening + p.text for p in a.parts) if a.equals else "" for a in x.attrs}


def _alike(a: Item, b: Item, h: Hashes) -> bool:
    if h(a) == h(b):
        return True
    if a.kind != b.kind or a.tag != b.tag or a.kind != "element":
        return False
    x, y = _attrs(a), _attrs(b)
    return x == y or not x or not y


def _common(old: list[Item], new: list[Item], h: Hashes) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence; for long lists the common ends only."""
    lo = 0
    while lo < min(len(old), len(new)) and h(old[lo]) == h(new[lo]):
        lo += 1
    hi = 0
    while hi < min(len(old), len(new)) - lo and h(old[-1 - hi]) == h(new[-1 - hi]):
        hi += 1
    ends = [(i, i) for i in range(lo)] + [(len(old) - 1 - i, len(new) - 1 - i) for i in range(hi)]
    a, b = old[lo : len(old) - hi], new[lo : len(new) - hi]
    if len(a) > LCS_LIMIT or len(b) > LCS_LIMIT or not a or not b:
        return sorted(ends)
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    same = [[_alike(x, y, h) for y in b] for x in a]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if same[i][j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if same[i][j] and size[i][j] == size[i + 1][j + 1] + 1:
            ends.append((lo + i, lo + j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return sorted(ends)


def diff(old: str | None, new: str | None) -> list[tuple[str, list[int], int | None, int | None, str | None, str | None]]:
    """Operations (type, path, old_index, new_index, old_value, new_value) that turn ``old`` into ``new``."""
    h = Hashes()
    a, b = tree_of(old), tree_of(new)
    ops: list[tuple] = []
    if h(a) == h(b):
        return ops
    work: list[tuple[Item, Item, list[int]]] = [(a, b, [])]
    while work:
        x, y, path = work.pop()
        if h(x) == h(y):
            continue
        if x.kind != y.kind:
            ops.append(("node_replaced", path, None, None, x.kind, y.kind))
            continue
        if x.kind in ("text", "literal", "comment", "doctype"):
            ops.append((("text" if x.kind in ("text", "literal") else x.kind) + "_changed", path, None, None, x.text, y.text))
            continue
        if x.kind in ("erb", "block") and (x.text, x.opening) != (y.text, y.opening):
            ops.append(("erb_content_changed", path, None, None, x.text, y.text))
        if x.kind == "element":
            if x.tag != y.tag:
                ops.append(("tag_name_changed", path, None, None, x.raw, y.raw))
            m, n = _attrs(x), _attrs(y)
            for name in sorted(m.keys() | n.keys()):
                if name not in n:
                    ops.append(("attribute_removed", path, None, None, name, None))
                elif name not in m:
                    ops.append(("attribute_added", path, None, None, None, name))
                elif m[name] != n[name]:
                    ops.append(("attribute_value_changed", path, None, None, m[name], n[name]))
        ops += _children(x, y, path, h, work)
    return ops


def _down(path: list[int], k: int) -> list[int]:
    return [*path, k] if len(path) < MAX_DEPTH else path


def _children(x: Item, y: Item, path: list[int], h: Hashes, work: list) -> list[tuple]:
    old, new = kids(x), kids(y)
    pairs = _common(old, new, h)
    kept_old, kept_new = {i for i, _ in pairs}, {j for _, j in pairs}
    for i, j in pairs:
        work.append((old[i], new[j], _down(path, j)))
    gone = [i for i in range(len(old)) if i not in kept_old]
    come = [j for j in range(len(new)) if j not in kept_new]
    ops: list[tuple] = []
    # moves: equal nodes elsewhere; then pairs of one tag or kind are kept and compared; wraps and unwraps
    for match in (lambda p, q: h(p) == h(q), lambda p, q: p.kind == q.kind and p.tag == q.tag):
        for i in list(gone):
            j = next((j for j in come if match(old[i], new[j])), None)
            if j is not None:
                gone.remove(i)
                come.remove(j)
                if h(old[i]) == h(new[j]) or sum(k < i for k in kept_old) != sum(k < j for k in kept_new):
                    ops.append(("node_moved", _down(path, j), i, j, None, None))
                work.append((old[i], new[j], _down(path, j)))
    for j in list(come):
        i = next((i for i in gone if _inside(old[i], new[j], h)), None)
        if i is not None:
            gone.remove(i)
            come.remove(j)
            ops.append(("node_wrapped", _down(path, j), i, j, None, new[j].tag))
    for i in list(gone):
        j = next((j for j in come if _inside(new[j], old[i], h)), None)
        if j is not None:
            gone.remove(i)
            come.remove(j)
            ops.append(("node_unwrapped", _down(path, j), i, j, old[i].tag, None))
    ops += [("node_removed", _down(path, i), i, None, old[i].kind, None) for i in gone]
    ops += [("node_inserted", _down(path, j), None, j, None, new[j].kind) for j in come]
    return ops


def _inside(small: Item, large: Item, h: Hashes) -> bool:
    todo, seek = kids(large), h(small)
    while todo:
        c = todo.pop()
        if h(c) == seek:
            return True
        todo += kids(c)
    return False


def diff_pairs(pairs: DataFrame) -> DataFrame:
    """Operations for ``pairs(pair_id, old, new)``.  Equal sources never reach Python; one scan, no shuffle."""

    def run(batches):
        for b in batches:
            rows = []
            for pair, old, new in zip(*(b.column(n).to_pylist() for n in ("pair_id", "old", "new")), strict=True):
                rows += [(pair, k, t, ".".join(map(str, p)), i, j, x, y) for k, (t, p, i, j, x, y) in enumerate(diff(old, new))]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select("pair_id", "old", "new").mapInArrow(run, SCHEMA)


def identical(old: str | None, new: str | None) -> bool:
    """Whether the trees have one root hash.  Some differences, as of quotes or of a tag's case, are no operation."""
    h, a, b = Hashes(), tree_of(old), tree_of(new)
    return h(a) == h(b)


def summary(pairs: DataFrame, ops: DataFrame) -> DataFrame:
    """(pair_id, operations, identical, patchable): patchable if the trees are identical, or if operations tell how they differ and all change texts or attributes."""
    per = checkpoint(ops.groupBy("pair_id").agg(F.count(F.lit(1)).alias("operations"), F.bool_and(F.col("type").rlike("^(text|attribute)_")).alias("patchable")))
    # unequal sources without an operation: few, so their ids go to the pairs
    silent = checkpoint(pairs.where(~F.col("old").eqNullSafe(F.col("new"))).select("pair_id").join(per, "pair_id", "left_anti").distinct())

    def run(batches):
        for b in batches:
            ids = [k for k, old, new in zip(*(b.column(n).to_pylist() for n in ("pair_id", "old", "new")), strict=True) if not identical(old, new)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["pair_id"])

    quiet = pairs.select("pair_id", "old", "new").where(~F.col("old").eqNullSafe(F.col("new")))
    quiet = quiet.join(F.broadcast(silent) if silent.count() <= BROADCAST_PAIRS else silent, "pair_id", "left_semi")
    unequal = quiet.mapInArrow(run, "pair_id long").distinct().withColumn("unequal", F.lit(True))
    same = F.col("operations").isNull() & F.col("unequal").isNull()
    return pairs.select("pair_id").join(per, "pair_id", "left").join(unequal, "pair_id", "left").select(
        "pair_id", F.coalesce("operations", F.lit(0)).alias("operations"), same.alias("identical"), F.coalesce("patchable", same).alias("patchable")
    )
