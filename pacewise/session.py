"""Session construction and lineage helpers."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "pacewise", shuffle_partitions: int | None = None) -> SparkSession:
    """Session for local runs, tests and cluster submits.

    Local (``master`` given, e.g. ``local[8]``): shuffle partitions sized to the
    cores. Cluster (no ``master``: the submitter's environment decides): the
    submitter's settings are kept; unset options get scale-ready defaults —
    AQE on (runtime coalescing from a large initial partition count, skew-join
    splitting), 256 MB input splits, UTC session time zone.
    """
    builder = SparkSession.builder.appName(app)
    local = master is not None
    if local:
        builder = builder.master(master)
        cpus = os.cpu_count() or 8
        builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or max(8, cpus)))
                   .config("spark.driver.memory", os.environ.get("PACEWISE_DRIVER_MEMORY", "16g"))
                   .config("spark.ui.enabled", "false")
                   .config("spark.ui.showConsoleProgress", "false"))
    elif shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if not local:
        defaults.update({
            # Start wide and let AQE coalesce: at 100 TB, 200 shuffle partitions would be ~500 GB each.
            "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
            "spark.sql.files.maxPartitionBytes": "256m",
        })
    for k, v in defaults.items():
        if local or spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
    try:
        spark.sparkContext.setLogLevel("ERROR" if local else "WARN")
    except Exception:  # Spark Connect
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` is used as-is. Where it is unset, a
    local session gets a private folder under the system temp dir; on a cluster
    that folder would be a different one on every machine, so this raises.
    Sessions without a SparkContext handle (Spark Connect) rely on the conf alone.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no JVM context on the client
        sc = None
    current = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    if not current:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share; "
                               f"a machine-local temp folder cannot serve master {master!r}")
        current = tempfile.mkdtemp(prefix="pacewise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint dir for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid

    _SCRATCH.append(f"{base}/{name}-{uuid.uuid4().hex[:12]}")
    return _SCRATCH[-1]


def scratch_given() -> int:
    """How many folders ``scratch_path`` has given out and nothing has dropped: a mark for ``scratch_since``."""
    return len(_SCRATCH)


def scratch_since(mark: int) -> list[str]:
    return _SCRATCH[mark:]


def drop_scratch(spark: SparkSession, folders: list[str] | None = None) -> int:
    """Delete ``folders`` of ``scratch_path``, or all that it gave out so far; call it once their results are no longer read.

    Returns the number of folders that existed. Goes through Hadoop's file
    system, so it reaches whatever store the checkpoint folder is in.
    """
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for folder in list(_SCRATCH if folders is None else folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        found += path.getFileSystem(conf).delete(path, True)
        if folder in _SCRATCH:
            _SCRATCH.remove(folder)
    return found


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into a scratch folder and read back: later reads see one evaluation of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Whether Spark drops a query's shuffle files when it has ended, not when the driver collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside, a step's shuffle files go when its table is written, so that disks hold one step's at a time; a user's setting is kept."""
    if spark.conf.get(DROP_SHUFFLES, None) is not None:
        yield
        return
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
