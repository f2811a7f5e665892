"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 digest of the
text. A batch is reduced to one row per digest (partial aggregation, so a text
with any number of copies costs one row per map task), matched against the
index by a sort-merge anti-join that reads the index without a shuffle, and the
digests that are new are appended as further sorted bucket files.

Two texts count as equal when their SHA-256 digests are equal.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pacewise.llm.common import keep_rows, numbered, stage, text_or_empty

NO_ID = -(1 << 63)  # sorts a missing doc_id below every other


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """A digest table at ``path`` (a folder that all executors share): digest, keep_id, group_size, batch.

    ``buckets`` is fixed when the index is created and is a sizing choice (one
    sorted file per bucket and batch); a reopened index must name the same
    number, which is part of the folder name.
    """

    COLUMNS = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/digests-{buckets}"
        self.name = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()
        # Reopening in a new session only needs the table's definition again: the files are the state.
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.COLUMNS}) USING PARQUET "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> DataFrame:
        """Add the digests of ``groups`` (digest, keep_id, group_size) that the index lacks; return its earlier rows.

        A batch that is appended twice under one name (a retry after a crash)
        leaves the index as after the first time: a failed write publishes no
        file, and rows already there are anti-joined away.
        """
        earlier = self.rows().where(F.col("batch") != batch).drop("batch")
        # Dealt out as the buckets are, the batch meets the index without a shuffle of the index and is written as it lies.
        dealt = groups.repartition(self.buckets, "digest")
        new = dealt.join(self.rows().select("digest"), "digest", "left_anti").withColumn("batch", F.lit(batch))
        (new.select("digest", "keep_id", "group_size", "batch").write.format("parquet").mode("append")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)
        return earlier


def digest_rows(docs: DataFrame, rid: Column | None = None) -> DataFrame:
    """(doc_id, digest, rid): one narrow row per document; rid (if not given, made here) tells repeated rows apart."""
    return docs.select("doc_id", text_digest(text_or_empty()).alias("digest"), (F.monotonically_increasing_id() if rid is None else rid).alias("rid"))


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest doc_id, the row that carries it, and the number of copies."""
    key = F.coalesce("doc_id", F.lit(NO_ID))
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.max_by("rid", key).alias("keep_rid"),
                                      F.count(F.lit(1)).alias("group_size"))


def exact_dedup(docs: DataFrame, index: DigestIndex, batch: str, rid: Column | None = None) -> DataFrame:
    """Deduplicate ``docs`` (doc_id, text) against themselves and ``index``, and append what is new.

    Returns doc_id, rid, digest, keep_id, group_size, kept for every input row,
    dropped ones too. Of equal texts in the batch the row with the largest
    doc_id stays, unless the index had the text before: then none stays and
    keep_id names the indexed row. group_size counts the batch's copies. A null
    text counts as empty; a null doc_id loses to any other; of rows that repeat
    text and doc_id exactly one stays. An empty table gives no rows.
    """
    rows = stage(digest_rows(docs, rid), "digest-rows")
    groups = stage(digest_groups(rows), "digest-groups")
    earlier = index.append(groups.select("digest", "keep_id", "group_size"), batch)
    seen = (groups.join(earlier.select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known")),
                        "digest", "left")
            .select("digest", F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.when(F.col("known").isNull(), F.col("keep_rid")).alias("keep_rid"), "group_size"))
    verdicts = stage(seen, "digest-verdicts")  # re-read: both join sides have an exchange that AQE can split
    return (rows.join(verdicts, "digest")
            .select("doc_id", "rid", "digest", "keep_id", "group_size",
                    F.coalesce(F.col("rid") == F.col("keep_rid"), F.lit(False)).alias("kept")))


def keep_one(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with all their columns."""
    rows = numbered(docs)
    found = exact_dedup(rows.select("_row.doc_id", "_row.text", "rid"), index, batch, F.col("rid"))
    return keep_rows(rows, found.where("kept"))
