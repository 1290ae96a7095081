"""Session helpers: shared checkpoints, shipping the package to executors, batch sizes."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def builder(cores: int = 8, partitions: int = 8, app: str = "tessera") -> SparkSession.Builder:
    """A local session as the tests and the bench use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Make ``spark`` ready for Python stages: small Arrow batches and an importable package.

    Texts may be very long, so a batch is bounded by rows and by bytes.
    """
    conf = spark.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    try:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception:  # noqa: BLE001  a Spark without this setting
        pass
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Send the package to executors that have no copy on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False) or str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "tessera_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in (_ROOT / "tessera").rglob("*.py"):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(target)
    sc._tessera_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder of ``spark.checkpoint.dir``.

    The folder comes from the session; only where it is unset, on one machine,
    a temporary folder is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``, set here only where nothing has set it and all run on one machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    configured = sc.getConf().get("spark.checkpoint.dir")
    if known.isEmpty():
        if not configured:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            configured = tempfile.mkdtemp(prefix="tessera-checkpoint-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
        known = sc._jsc.sc().getCheckpointDir()
    return configured or known.get()


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffles and checkpoints that nothing refers to any more.

    It does so when the driver's garbage is collected, which by itself happens only when the driver's heap fills.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate rows, wherever its file system is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, for stages that work long on each row, where a scan has fewer pieces than that.

    A large input has pieces enough and is left alone, and so are rows that come from a shuffle.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan.executedPlan().nodeName() == "AdaptiveSparkPlan" or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(2 * cores)
