"""Positions within a group without gathering the group in one task.

``ROW_NUMBER() OVER (PARTITION BY g ORDER BY o)`` puts every row of a group
into one task, so a group holding a third of the data becomes a third of the
job in one task. ``positions_within`` computes the same numbers with work
spread by ranges:

1. ``repartitionByRange(g, o)``: a hot group is split into several
   contiguous range partitions (the range bounds come from a sample), whose
   number follows the session's shuffle settings and AQE;
2. sort within each partition and take ``monotonically_increasing_id`` —
   (partition id << 33) + row index, so ids increase along the sort order;
   the numbered rows are written ONCE into the shared folder, because a second
   evaluation would draw other range bounds from another sample;
3. from that copy, per (partition, group) segment: the first id and the row
   count — at most (partitions + groups) rows;
4. a segment's offset = rows of the same group in earlier partitions (a
   running sum over that small table; at most one row per partition per group);
5. position = offset + (id − first id of the segment).

The order columns must be a total order within each group (add a unique
tie-breaker), so the numbering is reproducible when a task is retried.

LAG / LEAD then become equi-joins on (group, position ± 1), whose keys are
unique, so no join key can be hot either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacewise.session import written_once


def positions_within(df: DataFrame, group_cols: list[str], order_cols: list[str], pos_col: str = "_pos",
                     partitions: int | None = None) -> DataFrame:
    keys = [*group_cols, *order_cols]
    numbered = (df.repartitionByRange(*([partitions] if partitions else []), *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    ranged = written_once(numbered, "positions")
    seg = ranged.groupBy("_pid", *group_cols).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_offset", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    seg = seg.select(F.col("_pid").alias("_s_pid"), *[F.col(g).alias(f"_s_{g}") for g in group_cols],
                     "_first", "_offset")
    cond = F.col("_pid") == F.col("_s_pid")
    for g in group_cols:  # null-safe: a NULL group is a group too
        cond = cond & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    out = ranged.join(seg, cond)
    return out.withColumn(pos_col, F.col("_offset") + F.col("_mid") - F.col("_first")).drop(
        "_pid", "_mid", "_first", "_offset", "_s_pid", *[f"_s_{g}" for g in group_cols])


def shifted(df: DataFrame, group_cols: list[str], pos_col: str, value_cols: list[str], by: int,
            prefix: str) -> DataFrame:
    """Values of the row ``by`` positions earlier (by = 1: LAG) or later (by = -1: LEAD) in the same group."""
    other = df.select(*[F.col(g).alias(f"_o_{g}") for g in group_cols],
                      (F.col(pos_col) + F.lit(by)).alias("_o_pos"),
                      *[F.col(c).alias(f"{prefix}{c}") for c in value_cols])
    cond = F.col(pos_col) == F.col("_o_pos")
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    return df.join(other, cond, "left").drop("_o_pos", *[f"_o_{g}" for g in group_cols])



def running_sums(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, out_col: str) -> DataFrame:
    """``df`` with the running sum of ``value_col`` per group, its own row included, along a total order.

    Like ``positions_within``: ranges of (group, order) are written once, sums run within
    each range, and a range adds what its group's earlier ranges hold.
    """
    keys = [*group_cols, *order_cols]
    ranged = written_once(df.repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id()), "running-sums")
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    seg = ranged.groupBy("_pid", *group_cols).agg(F.sum(value_col).alias("_held")).withColumn("_offset", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    seg = seg.select(F.col("_pid").alias("_s_pid"), *[F.col(g).alias(f"_s_{g}") for g in group_cols], "_offset")
    cond = F.col("_pid") == F.col("_s_pid")
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_s_{g}"))
    along = Window.partitionBy("_pid", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.withColumn(out_col, F.coalesce(F.sum(value_col).over(along), F.lit(0)))
    return summed.join(seg, cond).withColumn(out_col, F.col(out_col) + F.col("_offset")).drop("_pid", "_offset", "_s_pid", *[f"_s_{g}" for g in group_cols])
