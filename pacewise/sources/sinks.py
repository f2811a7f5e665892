"""Sinks and table maintenance on Parquet (no transactional table format is available).

* snapshot overwrite, append, and date-partitioned writes with dynamic
  partition overwrite (only the partitions present in the batch are replaced);
* lineage stamping with the file each row came from (``_metadata.file_path``);
* an ingestion manifest (state, rows and error per source file) and an
  idempotent bulk load that skips files already in the manifest (left-anti
  join on the path), resumes batches that a dead load left pending and shares
  the work with loads that run at the same time (``claims.py``);
* compaction with range clustering on a key;
* as-of reads and batch history over append-only bronze tables.

Partitioned writes go through a REBALANCE hint on the partition column: AQE
splits a hot partition value into several tasks instead of one writer task.
"""

from __future__ import annotations

import datetime as _dt
import hashlib

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.operators.dedup import latest_first
from pacewise.sources.claims import EXPIRY_SECONDS, claim, wait_for


def bronze_stamp(df: DataFrame, batch_id: str, as_of: _dt.datetime = AS_OF, file_name_only: bool = True) -> DataFrame:
    """S-03: _ingested_at, _source_file (from the scan's file metadata) and _batch_id on every row."""
    src = F.col("_metadata.file_name") if file_name_only else F.col("_metadata.file_path")
    return df.select("*", F.lit(as_of).cast("timestamp").alias("_ingested_at"), src.alias("_source_file"),
                     F.lit(batch_id).alias("_batch_id"))


def write_overwrite(df: DataFrame, path: str) -> None:
    """S-04: replace the whole table."""
    df.write.mode("overwrite").parquet(path)


def write_append(df: DataFrame, path: str) -> None:
    """S-05: append a batch of facts."""
    df.write.mode("append").parquet(path)


def write_partitioned(df: DataFrame, path: str, partition_col: str, mode: str = "overwrite", dealt: bool = False) -> None:
    """S-06: partitioned write; overwrite replaces only the partitions present in ``df``, which is ``dealt`` out by them already or not."""
    ((df if dealt else df.hint("rebalance", partition_col)).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(path))


def list_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """Files under ``path`` as rows (path, length, modificationTime); file contents are not read."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(path).select("path", "length", "modificationTime"))


MANIFEST = ("table_name string, batch string, file_path string, attempt int, status string, rows_loaded bigint, "
            "loaded_at timestamp, error string")
#: Files that one batch of a bulk load holds at most: its paths are what the driver hands to the reader.
FILES_PER_BATCH = 10_000


def read_if_present(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, or no rows where there is none yet; any other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S-14: the state of every file of the manifest at ``path``: pending, success (with rows) or failed (with its error).

    The manifest is only appended to. A file's state is that of its last
    attempt; within an attempt an outcome replaces ``pending``.
    """
    rows = read_if_present(spark, path, MANIFEST)
    last = F.max(F.struct("attempt", (F.col("status") != "pending").alias("done"), "status", "rows_loaded", "loaded_at", "error"))
    states = rows.groupBy("table_name", "batch", "file_path").agg(last.alias("s"))
    return states.select("table_name", "batch", "file_path", "s.attempt", "s.status", "s.rows_loaded", "s.loaded_at", "s.error")


def bulk_load_once(spark: SparkSession, landing: str, target: str, manifest: str, table: str,
                   as_of: _dt.datetime = AS_OF, retry_failed: bool = False, files_per_batch: int = FILES_PER_BATCH,
                   claim_seconds: float = EXPIRY_SECONDS) -> int:
    """S-08: append only files that no earlier load has taken, each exactly once. Returns the files loaded by this call.

    New files are taken in batches of at most ``files_per_batch``. A batch is
    recorded as ``pending`` with its files BEFORE its data are written, into a
    folder of the attempt, in overwrite mode; then its files are recorded as
    ``success`` with their rows, or ``failed`` with the error. A load that
    finds pending batches (an earlier one died) first writes those again, same
    files, so files that landed meanwhile cannot change them.
    Failed batches stay failed until ``retry_failed``.

    Several loads may run at once: files are chosen by one of them at a time,
    and a batch that another holds a claim on is left to it. A claim older than
    ``claim_seconds`` counts as a dead load's. Should that load live after all,
    ``loaded_rows`` still shows each file once.
    """
    claims, loaded = f"{manifest.rstrip('/')}-claims/{table}", 0
    again = ["pending", "failed"] if retry_failed else ["pending"]

    def open_batches(batch: str | None = None) -> dict[str, int]:
        known = ingest_manifest(spark, manifest).where((F.col("table_name") == table) & F.col("status").isin(again))
        if batch is not None:
            known = known.where(F.col("batch") == batch)
        return {r["batch"]: r["attempt"] for r in known.groupBy("batch").agg(F.max("attempt").alias("attempt")).collect()}

    for batch in sorted(open_batches()):
        held = claim(spark, f"{claims}/{batch}", claim_seconds)
        if held:
            with held:
                attempt = open_batches(batch).get(batch)  # its state may have changed before the claim was ours
                if attempt is not None:
                    known = ingest_manifest(spark, manifest).where(F.col("table_name") == table)
                    loaded += _load_batch(spark, known, batch, attempt + 1, target, manifest, table, as_of)
    while True:
        with wait_for(spark, f"{claims}/choosing", claim_seconds):
            known = ingest_manifest(spark, manifest).where(F.col("table_name") == table)
            new = list_files(spark, landing).join(known, F.col("path") == F.col("file_path"), "left_anti")
            paths = [r["path"] for r in new.select("path").orderBy("path").limit(files_per_batch).collect()]
            if not paths:
                return loaded
            batch = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]
            held = wait_for(spark, f"{claims}/{batch}", claim_seconds)  # a new name: taken before others can see it
            rows = spark.createDataFrame([(p,) for p in paths], "file_path string")
            _record(rows, manifest, table, batch, 1, "pending", as_of)
        with held:
            loaded += _load_batch(spark, rows, batch, 1, target, manifest, table, as_of)


def _record(files: DataFrame, manifest: str, table: str, batch: str, attempt: int, status: str, as_of: _dt.datetime,
            rows: Column | None = None, error: str | None = None) -> None:
    """Add one manifest row for each of ``files`` (file_path), in a folder of its own: appends to one folder at once undo each other."""
    write_overwrite(files.select(
        F.lit(table).alias("table_name"), F.lit(batch).alias("batch"), "file_path", F.lit(attempt).alias("attempt"), F.lit(status).alias("status"),
        (rows if rows is not None else F.lit(None)).cast("long").alias("rows_loaded"), F.lit(as_of).cast("timestamp").alias("loaded_at"),
        F.lit(error).cast("string").alias("error")), f"{manifest.rstrip('/')}/_record={table}-{batch}-{attempt}-{status}")


def _load_batch(spark: SparkSession, files: DataFrame, batch: str, attempt: int, target: str, manifest: str, table: str,
                as_of: _dt.datetime) -> int:
    if "batch" in files.columns:  # an earlier load's batch: its files as they were recorded
        files = files.where(F.col("batch") == batch).select("file_path")
    paths = [r["file_path"] for r in files.orderBy("file_path").collect()]  # at most a batch
    if attempt > 1:
        _record(spark.createDataFrame([(p,) for p in paths], "file_path string"), manifest, table, batch, attempt, "pending", as_of)
    held = spark.createDataFrame([(p,) for p in paths], "file_path string")
    folder = f"{target}/_load={batch}-{attempt}"
    try:
        data = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("_landed_file"))
        data.write.mode("overwrite").parquet(folder)
        # Rows per file from the written copy's one column; the landed files are read once.
        counts = spark.read.parquet(folder).groupBy("_landed_file").agg(F.count(F.lit(1)).alias("n"))
        counted = held.join(counts, F.col("file_path") == F.col("_landed_file"), "left")
        _record(counted, manifest, table, batch, attempt, "success", as_of, F.coalesce("n", F.lit(0)))
    except (PySparkException, Py4JJavaError) as e:
        _record(held, manifest, table, batch, attempt, "failed", as_of, error=str(e))
        return 0
    return len(paths)


def loaded_rows(spark: SparkSession, target: str, manifest: str, table: str) -> DataFrame:
    """The rows of each loaded file once, without the load's own columns: of a batch its last attempt, if that succeeded.

    A file that two batches hold (two loads chose it, one of them taken for dead) counts in the first by name.
    """
    good = ingest_manifest(spark, manifest).where((F.col("table_name") == table) & (F.col("status") == "success"))
    loads = good.select(F.concat_ws("-", "batch", "attempt").alias("load")).distinct()
    twice = good.groupBy("file_path").agg(F.min("batch").alias("first"), F.max("batch").alias("last")).where("first <> last")
    extra = (good.join(twice, "file_path").where(F.col("batch") != F.col("first"))
             .select(F.concat_ws("-", "batch", "attempt").alias("load"), F.col("file_path").alias("_landed_file")))
    return (spark.read.parquet(target).withColumn("load", F.col("_load").cast("string")).join(loads, "load", "left_semi")
            .join(extra, ["load", "_landed_file"], "left_anti").drop("load", "_load", "_landed_file"))


#: Size that compaction aims at for a file.
FILE_BYTES = 256 << 20
#: Unpacked rows that one task of a compaction sorts: a packed file may unpack to many times its bytes.
SORT_BYTES = 1 << 30


def unpacked_bytes(table: DataFrame) -> int:
    """About what the rows of ``table`` take in a sort: a word a column and some a row, and the bytes of its texts."""
    texts = [f.name for f in table.schema.fields if f.dataType.typeName() in ("string", "binary")]
    lengths = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in texts]
    rows, *held = table.agg(F.count(F.lit(1)), *lengths).first()
    return rows * 8 * (len(table.columns) + 6) + sum(held)


def compact_cluster(spark: SparkSession, source: str, path: str, keys: list[str], file_bytes: int = FILE_BYTES,
                    sort_bytes: int = SORT_BYTES) -> int:
    """S-15: rewrite the Parquet table at ``source`` into range-partitioned files sorted by ``keys`` (min/max stats then skip files).

    The number of files follows the table's bytes, and its unpacked rows where
    these would be more than a task should sort. ``keys`` should end with a
    column that differs from row to row: a value of the first key that holds
    much of the table then spans files and tasks. Returns the number of files asked for.
    """
    size = list_files(spark, source).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    files = max(1, -(-size // file_bytes), -(-unpacked_bytes(spark.read.parquet(source)) // sort_bytes))
    spark.read.parquet(source).repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)
    return files


def as_of_snapshot(history: DataFrame, key: str, at: Column, ts: str = "_ingested_at") -> DataFrame:
    """S-16: the table as it was at ``at``: rows ingested by then, latest version per key."""
    w = Window.partitionBy(key).orderBy(*latest_first(history, ts))
    return (history.where(F.col(ts) <= at).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1)
            .drop("_rn"))


def batch_history(history: DataFrame) -> DataFrame:
    """S-16: one row per ingestion batch: rows, files, first and last ingestion time."""
    return history.groupBy("_batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("_source_file").alias("files"),
        F.min("_ingested_at").alias("first_ingested_at"), F.max("_ingested_at").alias("last_ingested_at"))


def read_merged(spark: SparkSession, *paths: str) -> DataFrame:
    """S-09: read Parquet batches whose schemas grew over time (union of columns, NULL where absent)."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def union_evolving(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)
