"""Point lookups in a written table.

``publish`` lays a table out for them once: a folder per hash bucket of the key,
rows sorted by the key inside, small row groups and a Parquet bloom filter on the
key. A lookup then reads the one bucket of its key (a partition filter), and in
its file the row groups whose statistics and bloom filter do not rule the key
out: its work does not follow the table, and nothing is built for it.

A table that grows is published again bucket by bucket: ``refresh`` rewrites the
buckets of the changed keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.sources.files import exists, list_names, write_text
from pacewise.sources.steps import Steps

BUCKET = "_bucket"
ROW_GROUP_BYTES = 4 << 20
PAGE_ROWS = 2_000


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of_table(spark: SparkSession, path: str) -> int:
    """The number of buckets that the table at ``path`` was published with (kept beside it)."""
    names = [n for n in list_names(spark, f"{path.rstrip('/')}-layout") if n.startswith("buckets=")]
    if len(names) != 1:
        raise ValueError(f"{path}: no published table")
    return int(names[0].removeprefix("buckets="))


def _sorted_buckets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    # A bucket is one task's: its size is the table's by the number of buckets, and no key has more than its own rows.
    return df.withColumn(BUCKET, bucket_of(F.col(key), buckets)).repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, key)


def _write(df: DataFrame, path: str, key: str, row_group_bytes: int) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
     .option("parquet.block.size", str(row_group_bytes)).option("parquet.page.row.count.limit", str(PAGE_ROWS))
     .partitionBy(BUCKET).parquet(path))


def publish(df: DataFrame, path: str, key: str, buckets: int, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Write ``df`` as a new table for lookups by ``key``; NULL keys lie in a bucket like any other.

    ``buckets`` is a sizing choice: about the table's bytes by those of a good file (256 MB).
    """
    spark = df.sparkSession
    if exists(spark, f"{path.rstrip('/')}-layout"):
        raise ValueError(f"{path} is published: refresh it")
    _write(_sorted_buckets(df, key, buckets), path, key, row_group_bytes)
    write_text(spark, f"{path.rstrip('/')}-layout/buckets={buckets}", key)


def refresh(changed: DataFrame, path: str, key: str, steps: Steps, row_group_bytes: int = ROW_GROUP_BYTES) -> list[int]:
    """Replace the rows of the keys in ``changed`` (NULL too) by its rows; returns the buckets rewritten.

    Only those buckets are read. A refresh that died is repeated with the same ``steps``, from its copies.
    """
    spark = changed.sparkSession
    buckets = buckets_of_table(spark, path)
    new = steps.table("new", lambda: changed.withColumn(BUCKET, bucket_of(F.col(key), buckets)))
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most the table's buckets
    if not touched:
        return []

    def merged() -> DataFrame:
        held = spark.read.parquet(path).where(F.col(BUCKET).isin(touched))
        keys = new.select(F.col(key).alias("_key")).distinct()
        rest = held.join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
        return rest.unionByName(new.select(*rest.columns))

    rows = steps.table("merged", merged)
    _write(_sorted_buckets(rows.drop(BUCKET), key, buckets), path, key, row_group_bytes)
    return touched


def look_up(spark: SparkSession, path: str, key: str, value: object) -> DataFrame:
    """The rows of the published table at ``path`` whose ``key`` is ``value``, under their own columns."""
    table = spark.read.parquet(path)
    typed = F.lit(value).cast(table.schema[key].dataType)
    # xxhash64 of a literal folds to a constant, so the bucket is a partition filter and the key a pushed one.
    bucket = bucket_of(typed, buckets_of_table(spark, path))
    return table.where((F.col(BUCKET) == bucket) & F.col(key).eqNullSafe(typed)).drop(BUCKET)
