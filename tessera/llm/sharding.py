"""Reproducible shuffle into shards by a Feistel permutation over global row numbers.

Rows get global numbers 0 to N-1 in the order of a hash of (doc_id, size,
checksum).  A mixed-radix Feistel network over ``a * b >= N`` cells, with cycle
walking back into 0 to N-1, permutes the numbers; shard and slot are the
remainder and the quotient of the permuted number, so shard sizes differ by one
at most, slots have no gaps, and both can be computed from a number alone.

Only DataFrame operations run.  Null ids and texts are values like any other
(a null text has no bytes and checksum 0).  Rows that agree in (doc_id, size,
checksum) are interchangeable: they are counted first and expanded to distinct
numbers afterwards, so one key may hold any share of all rows.  An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._io import columns
from tessera.session import checkpoint

ROUNDS = 4
#: Rows numbered in one window at most, on average.
BUCKET_ROWS = 50_000


def _hash_long(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed=seed)


@dataclass(frozen=True)
class Feistel:
    """A permutation of 0 to n-1; the same in SQL (``column``) and Python (``apply``)."""

    n: int
    seed: int = 0

    @property
    def sides(self) -> tuple[int, int]:
        a = math.isqrt(max(self.n, 1) - 1) + 1
        return a, max(1, -(-self.n // a))

    def _step(self, x: int) -> int:
        a, b = self.sides
        left, right = x % a, x // a
        for r in range(ROUNDS):
            if r % 2:
                right = (right + self._f(left, r) % b) % b
            else:
                left = (left + self._f(right, r) % a) % a
        return right * a + left

    def _f(self, x: int, r: int) -> int:
        """The same as xxhash64(seed and round, x) without its sign bit."""
        return _hash_long(x, _hash_long(self.seed * ROUNDS + r, 42)) & (1 << 62) - 1

    def apply(self, x: int) -> int:
        x = self._step(x)
        while x >= self.n:
            x = self._step(x)
        return x

    def walk(self) -> int:
        """The longest run of steps that any number in range needs beyond the first.

        Only the cells past n, fewer than a side, are followed.
        """
        a, b = self.sides
        beyond = {x: self._step(x) for x in range(self.n, a * b)}
        longest = 0
        entered = set(beyond) - set(beyond.values())
        for x in entered:
            k = 0
            while x in beyond:
                x, k = beyond[x], k + 1
            longest = max(longest, k)
        return longest

    def column(self, x: Column) -> Column:
        a, b = self.sides

        def f(v: Column, r: int) -> Column:
            return F.xxhash64(F.lit(self.seed * ROUNDS + r).cast("long"), v).bitwiseAND(F.lit((1 << 62) - 1))

        def step(v: Column) -> Column:
            def turn(r: int):
                def one(p: Column) -> Column:
                    left, right = p["l"], p["r"]
                    if r % 2:
                        right = F.pmod(right + F.pmod(f(left, r), F.lit(b)), F.lit(b))
                    else:
                        left = F.pmod(left + F.pmod(f(right, r), F.lit(a)), F.lit(a))
                    return F.struct(left.alias("l"), right.alias("r"))

                return one

            # a one-element transform names the pair, so an expression is not repeated inside the next
            pair = F.array(F.struct(F.pmod(v, F.lit(a)).cast("long").alias("l"), F.call_function("div", v, F.lit(a)).alias("r")))
            for r in range(ROUNDS):
                pair = F.transform(pair, turn(r))
            return F.element_at(F.transform(pair, lambda p: p["r"] * F.lit(a) + p["l"]), 1)

        extra = self.walk()
        out = step(x)
        if extra:
            out = F.aggregate(F.sequence(F.lit(1), F.lit(extra)), out, lambda acc, _: F.when(acc >= self.n, step(acc)).otherwise(acc))
        return out


def expanded(keys: DataFrame, copies: str, into: str, by: str, run: int = 10_000) -> DataFrame:
    """Each row of ``keys`` as often as ``copies`` says, numbered from 0 in ``into``; many copies are dealt to tasks in runs first."""
    runs = keys.withColumn("_from", F.explode(F.expr(f"sequence(0L, {copies} - 1, {run}L)"))).repartition(by, "_from")
    return runs.withColumn(into, F.explode(F.expr(f"sequence(_from, least(_from + {run - 1}, {copies} - 1))"))).drop("_from")


def numbered(keys: DataFrame, by: list[str], salt: int = 0) -> tuple[DataFrame, int]:
    """``keys`` with a dense ``number`` from 0 and the row count; rows equal in ``by`` become ``copies`` of one key first.

    Keys are dealt into buckets by the leading bits of a hash, numbered within
    their bucket, and shifted by the counts of the buckets before.  The number
    of buckets follows the rows and does not change the numbers.
    """
    counted = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("copies")).withColumn("turn", F.xxhash64(F.lit(salt), *by))
    counted = checkpoint(counted)
    rows, distinct = counted.agg(F.sum("copies"), F.count(F.lit(1))).first()
    bits = max(0, (max(1, (distinct or 0) // BUCKET_ROWS)).bit_length() + 1)
    counted = counted.withColumn("bucket", F.shiftrightunsigned(F.col("turn"), 64 - bits).cast("long"))
    sizes = counted.groupBy("bucket").agg(F.sum("copies").alias("size"))
    # a row for each bucket: its number follows rows / BUCKET_ROWS
    first = sizes.withColumn("first", F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", F.coalesce("first", F.lit(0)).alias("first"))
    within = Window.partitionBy("bucket").orderBy("turn", *by).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("copies").over(within), F.lit(0))
    start = counted.withColumn("before", before).join(first, "bucket").withColumn("start", F.col("first") + F.col("before"))
    out = expanded(start, "copies", "copy", "turn").withColumn("number", F.col("start") + F.col("copy"))
    return out.select(*by, "number"), int(rows or 0)


def dealt(docs: DataFrame, shards: int = 24, seed: int = 20240229) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: the corpus itself, every row whole, by the same law.

    Rows that are equal in all columns, told by 128 bits of hash, are
    interchangeable, and one of them is joined to the places of all.
    """
    names = docs.columns
    turned = docs.select("*", F.xxhash64(F.lit(seed), *names).alias("_turn"), F.xxhash64(F.lit(seed + 1), *names).alias("_turn2"))
    rows, n = numbered(turned.select("_turn", "_turn2"), ["_turn", "_turn2"], seed)
    place = rows.select("_turn", "_turn2", Feistel(max(n, 1), seed).column(F.col("number")).alias("_place"))
    return turned.dropDuplicates(["_turn", "_turn2"]).join(place, ["_turn", "_turn2"]).select(
        *names, F.pmod("_place", F.lit(shards)).cast("int").alias("shard"), F.call_function("div", F.col("_place"), F.lit(shards)).alias("slot")
    )


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240229, overhead: int = 8) -> DataFrame:
    """Contract rows: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under the law ``rows``)."""
    text = F.col("text")
    keys = columns(docs, "doc_id", "text").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows, n = numbered(keys, ["doc_id", "size", "text_crc32"], seed)
    place = Feistel(max(n, 1), seed).column(F.col("number"))
    return rows.withColumn("place", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.call_function("div", F.col("place"), F.lit(shards)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
