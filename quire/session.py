"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one task cuts into words: each becomes a row, of which some
# sorts hold all, about sixty times the text.
TASK_TEXT = 1 << 22


def get_spark(app: str = "quire", cpus: str | int = "*", shuffle_partitions: int | None = None,
              driver_memory: str = "16g") -> SparkSession:
    """Local session with the settings the library is tuned for.

    On a cluster the session comes from the launcher; this helper is for
    tests, the bench and local runs only.
    """
    parts = shuffle_partitions or (os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # model stages must not run twice for the same input
        .config("spark.speculation", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint location.

    The location is read from ``spark.checkpoint.dir`` (or the context's
    checkpoint dir).  Only a local-mode session without one gets a scratch
    folder of its own; a cluster session without a shared folder is an error,
    because a machine-local folder would not survive the loss of an executor.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS or S3)")
        base = tempfile.mkdtemp(prefix="quire-ckpt-")
        spark.sparkContext.setCheckpointDir(base)
        try:  # some sessions refuse runtime changes of core settings
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:
            pass
    base = base.rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def written(df, name: str):
    """``df`` written to a fresh shared folder and read back: the lineage ends
    there, and what was computed outlives any executor."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_tasks(texts: DataFrame, text_col: str) -> int:
    """Tasks to deal ``texts`` to, so that none gets much more than
    ``TASK_TEXT`` bytes however many there are: one per core at least."""
    total = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_TEXT))


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable on executors (for the pandas UDFs and
    ``mapInPandas`` stages): zip the package once per context and add it with
    ``addPyFile``, the programmatic form of ``--py-files``.  Python workers
    do not inherit the driver's ``sys.path``, so this is needed in local mode
    too whenever the driver was not started from the repository root."""
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="quire-pkg-"), "quire.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith((".py", ".txt")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(id(sc))
