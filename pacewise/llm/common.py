"""Shared pieces of the training-data operators: readers, the word pattern, staged tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.session import DROP_SHUFFLES, scratch_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back.

    The copy cuts the lineage (a lost executor costs a re-read, not a
    recomputation), fixes non-deterministic columns such as row ids, and gives
    both sides of later joins their own exchange, which AQE can split when a
    key is hot.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table with more rows than this is joined by shuffle instead of broadcast (rows of these tables are some 100 bytes).
BROADCAST_ROWS = 20_000


def look_up(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Left-join ``rows`` with the row of ``small`` for their ``key`` (null is a key like any other).

    ``small`` has a row per key and comes last, without its key. It is staged
    and counted: up to BROADCAST_ROWS it is broadcast, else both sides are
    shuffled and AQE splits keys that hold many of the rows.
    """
    small = stage(small, "lookup").withColumnRenamed(key, "_key")
    few = small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(small) if few else small, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


#: Rows of one Arrow batch that carries whole texts: some megabytes, several times which a Python worker holds.
TEXT_BATCH = 1_000
#: Rows of one vector that Parquet is read into, and bytes of a row group that a task holds while it writes: a task's heap with whole texts.
VECTOR_ROWS, ROW_GROUP_BYTES = 512, 16 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ_ROWS, WRITE_BYTES = "spark.sql.parquet.columnarReaderBatchSize", "parquet.block.size"


def text_session(df: DataFrame) -> DataFrame:
    """``df``, in a session set up for operators that move whole texts in several written steps.

    Arrow batches have at most TEXT_BATCH rows, vectors of a Parquet scan at most
    VECTOR_ROWS, row groups that are written about ROW_GROUP_BYTES (smaller
    settings are kept), and the shuffle files of a step go when its table is
    written, so that disks hold one step's shuffles at a time; a setting of the
    user's is kept.
    """
    conf = df.sparkSession.conf
    for name, most in ((ARROW_ROWS, TEXT_BATCH), (READ_ROWS, VECTOR_ROWS), (WRITE_BYTES, ROW_GROUP_BYTES)):
        if not 0 < int(conf.get(name, "0")) <= most:
            conf.set(name, str(most))
    if conf.get(DROP_SHUFFLES, None) is None:
        conf.set(DROP_SHUFFLES, "true")
    return df


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def whole_row(df: DataFrame, name: str = "_row") -> Column:
    """All columns of ``df`` as one struct, so that added columns can never clash with its names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def numbered(docs: DataFrame) -> DataFrame:
    """A written copy of ``docs`` as (_row, rid): row ids come from one evaluation, whatever the cores or splits of a later read."""
    return stage(text_session(docs).select(whole_row(docs), F.monotonically_increasing_id().alias("rid")), "numbered-rows")


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The ``_row`` of those rows of a written copy (``numbered``) whose rid is in ``kept``; a sort-merge join at every size."""
    return rows.join(stage(kept.select("rid"), "kept-rows").hint("merge"), "rid", "left_semi").select("_row.*")
