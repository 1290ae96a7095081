"""A change feed of templates: differences and new offenses for each change, the last source kept as state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.diff import diff
from tessera.operators.parser import parse
from tessera.session import prepare

OPS = "path string, seq long, kind string, op_index int, type string, at string"
ERRORS = "path string, seq long, name string, line int"


def diff_stream(feed: DataFrame) -> DataFrame:
    """Operations for each change of a streaming ``feed(seq, path, kind, source)``; the last source of a path is its state."""
    prepare(feed.sparkSession)

    def run(key, batches, state: GroupState):
        last = state.get[0] if state.exists else ""
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            source = "" if r.kind == "removed" else r.source or ""
            for k, (kind, path, *_) in enumerate(diff(last, source)):
                rows.append((key[0], r.seq, r.kind, k, kind, ".".join(map(str, path))))
            last = source
        state.update((last,))
        yield pd.DataFrame(rows, columns=["path", "seq", "kind", "op_index", "type", "at"])

    return feed.groupBy("path").applyInPandasWithState(run, OPS, "source string", "append", GroupStateTimeout.NoTimeout)


def new_error_stream(feed: DataFrame) -> DataFrame:
    """Parse errors whose name and line the path's last source did not have."""
    prepare(feed.sparkSession)

    def run(key, batches, state: GroupState):
        known = {tuple(x.split("\t")) for x in state.get[0].split("\n") if x} if state.exists else set()
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            now = set() if r.kind == "removed" else {(x["name"], str(x["line"])) for x in parse(r.source) if x["kind"] == "error"}
            rows += [(key[0], r.seq, name, int(line)) for name, line in sorted(now - known)]
            known = now
        state.update(("\n".join("\t".join(x) for x in sorted(known)),))
        yield pd.DataFrame(rows, columns=["path", "seq", "name", "line"])

    return feed.groupBy("path").applyInPandasWithState(run, ERRORS, "known string", "append", GroupStateTimeout.NoTimeout)


def upsert_index(write: Callable[[DataFrame, int], None], feed: DataFrame):
    """A sink that hands each micro-batch's last change of every path to ``write``."""
    from pyspark.sql import functions as F

    def each(batch: DataFrame, epoch: int) -> None:
        last = batch.groupBy("path").agg(F.max_by(F.struct("seq", "kind", "source"), F.col("seq")).alias("x")).select("path", "x.*")
        write(last, epoch)

    return feed.writeStream.foreachBatch(each)
