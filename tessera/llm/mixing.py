"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words of a source, its documents in a seeded order, are cut into blocks of
``block`` words; a second pass over the source gives as many again.  The blocks
of the mix are seats: they go to sources by highest quotients target / (2k - 1).
The apportionment is house-monotone, so the seats of the first s shards are the
apportionment of s / S of the house, and their differences are integer quotas
per shard.  Which blocks fill a source's seats is a seeded permutation of its
blocks, first pass before second: the first quota of them fills the first
shard, the next the second, and so on.

Seats are whole blocks, so they miss a target by up to half a block, and miss a
source of less than half a block altogether.  The last block of a source is
therefore cut, or one more begun, where the words taken reach the target.

Null texts have no words.  A null source is a source of its own, last in order.
Repeated ids and rows are documents of their own.  Sources without words have
target 0.  An empty table gives an empty result.  Extra columns are ignored.
Equal quotients go to the source first in order.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from tessera.llm._io import Batches, columns
from tessera.llm.sharding import expanded
from tessera.session import checkpoint

BLOCK = 64
SHARDS = 24
WEIGHTS = (3, 1, 2)
#: Rows of a bucket at most, on average, and the fewest buckets of a source, as a power of two.
BUCKET_ROWS, BUCKET_BITS = 50_000, 6
#: The table of sources is broadcast up to this many rows, and joined by shuffle beyond.
BROADCAST_SOURCES = 10_000
_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = re.compile(_WORD).finditer


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> list[Fraction]:
    """Targets of sources by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    total = share * sum(sizes)
    out: list[Fraction | None] = [None] * len(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    while True:
        open_ = [i for i, t in enumerate(out) if t is None]
        left = total - sum(t for t in out if t is not None)
        weight = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] > most * sizes[i] * weight]
        for i in over:
            out[i] = Fraction(most * sizes[i])
        if not over:
            for i in open_:
                out[i] = left * w[i] / weight
            return out  # type: ignore[return-value]


def apportion(votes: list[Fraction], seats: int) -> list[int]:
    """Sainte-Lague: seat k of a party has the quotient votes / (2k - 1); the highest win, the earlier party on a tie.

    A divisor near the last quotient gives all seats but a few, so the work does
    not grow with the house.
    """
    total = sum(votes)
    if not total or not seats:
        return [0] * len(votes)
    got = [max(0, math.floor(v * seats / total + Fraction(1, 2)) - 1) for v in votes]
    # the guess may exceed a party's share when many small parties round up: take the lowest quotients back
    while sum(got) > seats:
        i = min((j for j in range(len(votes)) if got[j]), key=lambda j: (votes[j] / (2 * got[j] - 1), -j))
        got[i] -= 1
    while sum(got) < seats:
        i = max(range(len(votes)), key=lambda j: (votes[j] / (2 * got[j] + 1), -j))
        got[i] += 1
    # exchange until no seat's quotient is above a lost one's
    while True:
        gain = max(range(len(votes)), key=lambda j: (votes[j] / (2 * got[j] + 1), -j))
        lose = min((j for j in range(len(votes)) if got[j]), key=lambda j: (votes[j] / (2 * got[j] - 1), -j))
        if (votes[gain] / (2 * got[gain] + 1), -gain) <= (votes[lose] / (2 * got[lose] - 1), -lose):
            return got
        got[gain] += 1
        got[lose] -= 1


@dataclass(frozen=True)
class Share:
    """What a source gives: ``seats`` of ``2 * blocks`` blocks, in shards by ``quotas``.

    ``fill`` has for each pass the number of whole blocks taken and the words
    of the block that follows in the permutation.
    """

    source: str | None
    size: int
    target: Fraction
    blocks: int
    quotas: tuple[int, ...]
    step: int
    offset: int
    fill: tuple[tuple[int, int], ...]

    @property
    def seats(self) -> int:
        return sum(self.quotas)


def plan(sizes: list[tuple[str | None, int]], block: int = BLOCK, shards: int = SHARDS, seed: int = 0) -> list[Share]:
    """Targets, quotas per shard and the permutation of each source's blocks; ``sizes`` has a row for each source, in order.

    The work grows with sources times shards, on the driver.
    """
    goal = targets([s for _, s in sizes])
    house = round(sum(goal) / block)
    by_shard = [apportion(goal, house * (k + 1) // shards) for k in range(shards)]
    out = []
    for i, (source, size) in enumerate(sizes):
        n = -(-size // block)
        seats = [min(x[i], 2 * n) for x in by_shard]
        step, offset = _step(n, seed + i)
        words = math.floor(goal[i] + Fraction(1, 2))
        fill = tuple(_fill(x, size, n, block, step, offset) for x in (min(words, size), max(0, words - size)))
        out.append(Share(source, size, goal[i], n, tuple(b - a for a, b in zip([0, *seats], seats, strict=False)), step, offset, fill))
    return out


def _fill(words: int, size: int, n: int, block: int, step: int, offset: int) -> tuple[int, int]:
    """How many leading blocks of the permutation have at most ``words`` words, and what they leave; the source's last block may be short."""
    if not n:
        return 0, 0
    short = n * block - size
    last = ((n - 1) * step + offset) % n
    have = lambda f: f * block - (short if last < f else 0)
    f = min(n, (words + short) // block)
    if have(f) > words:
        f = words // block
    return f, words - have(f)


def _step(n: int, seed: int) -> tuple[int, int]:
    """A multiplier prime to n, near the golden section of it, and an offset."""
    if n < 2:
        return 1, 0
    step = max(1, int(n * 0.6180339887498949) + seed * 7919 % 97)
    while math.gcd(step, n) != 1:
        step += 1
    return step % n, seed * 104729 % n


#: Rank of block ``j`` in its source's permutation.  Products of numbers below 2**40 are made in two halves, so they fit a long.
_RANK = "pmod(pmod(pmod(j * (step div 1048576), blocks) * 1048576, blocks) + j * (step % 1048576) + offset, blocks)"


def mix(docs: DataFrame, seed: int = 20240229, block: int = BLOCK, shards: int = SHARDS, also: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, words taken by the ``first_pass`` and ``second_pass``,
    and ``turn``, ``turn2``, ``start``, ``step``, ``offset``, ``blocks``, ``fill``, ``quotas``, from which ``cuts`` finds the taken words and their shards.

    Documents lie in their source in the order of the hashes ``turn`` and ``turn2``
    of (doc_id, text, source, ``also``); positions come from counts of hash
    buckets and a window within each, so a source that holds a third of all rows
    is spread over many tasks.
    """
    spark = docs.sparkSession
    base = columns(docs, "doc_id", "text", "source", *also).select("doc_id", "source", word_count(F.col("text")).alias("size"), *_turns(seed, also))
    base = checkpoint(base)
    # one row for each source reaches the driver: the apportionment is over sources
    sizes = [(r["source"], r["size"], r["rows"]) for r in base.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()]
    sizes.sort(key=lambda r: (r[0] is None, r[0] or ""))
    shares = plan([(s, n) for s, n, _ in sizes], block, shards, seed)
    known = spark.createDataFrame(
        [(s.source, s.size, float(s.target), s.blocks, s.step, s.offset, [x for f in s.fill for x in f], list(s.quotas)) for s in shares],
        "s string, source_size long, target double, blocks long, step long, offset long, fill array<long>, quotas array<long>",
    )
    known = F.broadcast(known) if len(shares) <= BROADCAST_SOURCES else known
    bits = max(BUCKET_BITS, (sum(r for *_, r in sizes) // BUCKET_ROWS).bit_length() + 2)
    base = base.withColumn("bucket", F.shiftrightunsigned(F.col("turn"), 64 - bits).cast("long"))
    # rows equal in turns are interchangeable: copies are counted, and expanded after their window
    keys = base.groupBy("source", "bucket", "turn", "turn2", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    words = F.col("size") * F.col("copies")
    within = Window.partitionBy("source", "bucket").orderBy("turn", "turn2", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    keys = keys.withColumn("before", F.coalesce(F.sum(words).over(within), F.lit(0)))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        base.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(over), F.lit(0)).alias("first"))
    )
    placed = keys.join(firsts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    placed = expanded(placed, "copies", "copy", "turn").withColumn("start", F.expr("first + before + copy * size"))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    inside = (
        f"case when size = 0 or (fill[{{k}}] = 0 and fill[{{k}} + 1] = 0) then 0L else aggregate(transform(sequence(start div {block}, (start + size - 1) div {block}), j -> struct(j, {_RANK} as rank)), 0L, (n, x) -> n + "
        f"greatest(0L, least(x.j * {block} + case when x.rank < fill[{{k}}] then {block} when x.rank = fill[{{k}}] then fill[{{k}} + 1] else 0L end, start + size) - greatest(x.j * {block}, start))) end"
    )
    return (
        placed.withColumn("first_pass", F.expr(inside.format(k=0)))
        .withColumn("second_pass", F.expr(inside.format(k=2)))
        .select("doc_id", "size", "source_size", "target", F.expr("first_pass + second_pass").alias("taken"), "first_pass", "second_pass", "turn", "turn2", "start", "step", "offset", "blocks", "fill", "quotas")
    )


def _turns(seed: int, also: tuple[str, ...]) -> list[Column]:
    """128 bits that tell documents apart."""
    return [F.xxhash64(F.lit(seed + k), "doc_id", "text", "source", *also).alias(name) for k, name in enumerate(("turn", "turn2"))]


def cuts(text: str, start: int, step: int, offset: int, blocks: int, fill: list[int], quotas: list[int], block: int, again: int) -> dict[int, str]:
    """By shard, the words of ``text`` that pass ``again`` (0 or 1) takes; ``text`` begins at word ``start`` of its source.

    Runs of words keep their white space, and stand on lines of their own.
    """
    words = [m.span() for m in _WORDS(text)]
    ends = list(accumulate(quotas))
    whole, rest = fill[2 * again : 2 * again + 2]
    runs: dict[int, list[list[int]]] = {}
    for j in range(start // block, (start + len(words) - 1) // block + 1) if words else ():
        rank = (j * step + offset) % blocks
        a = max(j * block, start) - start
        b = min(j * block + (block if rank < whole else rest if rank == whole else 0), start + len(words)) - start
        if a < b:
            shard = min(bisect_right(ends, rank + again * blocks), len(ends) - 1)
            mine = runs.setdefault(shard, [])
            if mine and mine[-1][1] == a:
                mine[-1][1] = b
            else:
                mine.append([a, b])
    return {shard: "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in found) for shard, found in runs.items()}


def mixed(docs: DataFrame, names: tuple[str, ...] = ("doc_id", "text", "lang", "source", "n_chars"), seed: int = 20240229, block: int = BLOCK, by_shard: bool = False, **options) -> DataFrame:
    """The mix itself: the columns ``names``, a row for each pass that takes words of a document, ``text`` holding those words.

    A text taken whole keeps its exact form.  ``n_chars``, where given, is that
    of the taken text.  With ``by_shard`` a row holds the words of one shard,
    whose number follows as ``shard``.
    """
    also = tuple(n for n in names if n not in ("doc_id", "text", "source"))
    plan_ = mix(docs, seed=seed, block=block, also=also, **options).where("taken > 0").drop("doc_id", "source_size", "target", "taken")
    unique = columns(docs, *names).withColumns(dict(zip(("turn", "turn2"), _turns(seed, also), strict=True))).dropDuplicates(["turn", "turn2"])
    rows = unique.join(plan_, ["turn", "turn2"]).withColumn("pass", F.explode(F.expr("array_compact(array(case when first_pass > 0 then 0 end, case when second_pass > 0 then 1 end))")))
    kept = rows.withColumn("whole", F.expr("case when pass = 0 then first_pass else second_pass end = size"))
    schema = columns(docs, *names).schema
    if by_shard:
        schema = StructType([*schema.fields]).add("shard", IntegerType())

    def run(batches: Batches) -> Batches:
        for b in batches:
            get = [b.column(n).to_pylist() for n in ("text", "whole", "start", "step", "offset", "blocks", "fill", "quotas", "pass")]
            at, texts, shards = [], [], []
            for i, (t, whole, start, step, offset, blocks, fill, quotas, again) in enumerate(zip(*get, strict=True)):
                if whole and not by_shard:
                    found = {0: t}
                else:
                    found = cuts(t, start, step, offset, blocks, fill, quotas if by_shard else [0], block, again)
                at += [i] * len(found)
                texts += found.values()
                shards += found
            cols = {n: b.column(n).take(pa.array(at, pa.int64())) for n in names}
            cols["text"] = pa.array(texts, cols["text"].type)
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([len(t) for t in texts], cols["n_chars"].type)
            if by_shard:
                cols["shard"] = pa.array(shards, pa.int32())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return kept.mapInArrow(run, schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """Contract rows: doc_id, size, source_size, target, taken."""
    return mix(docs, **options).select("doc_id", "size", "source_size", "target", "taken")
