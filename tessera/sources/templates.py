"""Reading template files into a corpus, and writing results."""

from __future__ import annotations

import fnmatch

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.directives import named
from tessera.session import prepare

#: Default file patterns of a project.
INCLUDE = (named("*.{word}"), "*.html.erb", named("*.html.{word}"), "*.html", "*.rhtml", "*.turbo_stream.erb")
EXCLUDE = ("coverage", "log", "node_modules", "storage", "tmp", "vendor")


def templates(spark: SparkSession, folder: str, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """``(doc_id, path, source)`` of the template files under a shared folder; ``doc_id`` is a hash of the path.

    Partials begin with an underscore, which Spark's own readers take for hidden
    files.  So the driver lists names, as it does for those readers, and tasks
    open the files through the folder's file system.
    """
    prepare(spark)
    fs, root = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
    root = root.rstrip("/")
    files = [f.path[len(root) + 1 :] for f in fs.get_file_info(pa.fs.FileSelector(root, recursive=True)) if f.is_file]
    files = sorted(p for p in files if any(fnmatch.fnmatch(p.rsplit("/", 1)[-1], x) for x in include) and not set(p.split("/")[:-1]) & set(exclude))

    def read(batches):
        mine, top = pa.fs.FileSystem.from_uri(folder) if "://" in folder else (pa.fs.LocalFileSystem(), folder)
        for b in batches:
            names = b.column("path").to_pylist()
            texts = []
            for n in names:
                with mine.open_input_stream(f"{top.rstrip('/')}/{n}") as f:
                    texts.append(f.read().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], names=["path", "source"])

    paths = spark.createDataFrame([(p,) for p in files], "path string").repartition(max(1, min(len(files) // 200 + 1, 10_000)))
    return paths.mapInArrow(read, "path string, source string").select(F.xxhash64("path").alias("doc_id"), "path", "source")


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
