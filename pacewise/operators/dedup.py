"""Deduplication and history operators (window functions).

``dedup_latest`` is ROW_NUMBER() = 1 per key. Catalyst turns the rank filter
into a WindowGroupLimit that runs *before* the shuffle as well as after it, so
each map task forwards at most one row per key: a hot key holding a third of
the input costs one row per map task in the exchange, not a third of the data
in one reducer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_latest(df: DataFrame, key: str | list[str], order: list[Column] | None = None) -> DataFrame:
    """Latest row per key by ``_ingested_at`` desc, or by ``order``, which must be a total order.

    Versions of one ingestion time go by batch, source file and a hash of the
    whole row, so the same row wins however the data are dealt out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = order or latest_first(df)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row_num", F.row_number().over(w)).where(F.col("_row_num") == 1).drop("_row_num")


def latest_first(df: DataFrame, ts: str = "_ingested_at") -> list[Column]:
    stamps = [c for c in ("_batch_id", "_source_file") if c in df.columns]
    return [F.col(ts).desc(), *[F.col(c).desc() for c in stamps], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]


def scd2_history(df: DataFrame, key: str, tracked: str, ts: str = "_ingested_at",
                 tie_breakers: list[str] | None = None) -> DataFrame:
    """SCD-2 rows: the first version of each key and every version whose tracked value changed.

    ``_valid_from`` is the version's ingestion time, ``_valid_to`` the next kept
    version's (NULL = current), ``_is_current`` marks the open version.

    Skew-safe: versions are numbered per key with ``positions_within`` (range
    partitioned, so a key with a huge history is spread over many tasks) and
    the previous / next version are equi-joins on (key, position ± 1) instead
    of LAG / LEAD windows that would sort a whole key in one task.
    """
    from pacewise.operators.sequence import positions_within, shifted

    order = [ts, *(tie_breakers or [])]
    v = positions_within(df, [key], order, "_pos")
    v = shifted(v, [key], "_pos", [tracked], 1, "_prev_")
    kept = v.where((F.col("_pos") == 0) | ~F.col(f"_prev_{tracked}").eqNullSafe(F.col(tracked))).drop(
        f"_prev_{tracked}", "_pos")
    k = positions_within(kept, [key], order, "_kpos")
    k = shifted(k, [key], "_kpos", [ts], -1, "_next_")
    return (k.withColumn("_valid_from", F.col(ts)).withColumn("_valid_to", F.col(f"_next_{ts}"))
            .withColumn("_is_current", F.col(f"_next_{ts}").isNull()).drop(f"_next_{ts}", "_kpos"))


def active_on(history: DataFrame, at: Column) -> DataFrame:
    """Versions valid at instant ``at``: valid_from <= at < valid_to (open end = current)."""
    return history.where((F.col("_valid_from") <= at) & (F.col("_valid_to").isNull() | (at < F.col("_valid_to"))))


def assign_round_robin(work: DataFrame, roster: DataFrame, role_col: str, order: list[str],
                       roster_role: str = "role", roster_member: str = "member") -> DataFrame:
    """Round-robin: the n-th item of a role (by ``order``, a total order) goes to member n mod roster-size.

    Items and roster members are numbered per role with ``positions_within``
    (no role is ever gathered into one task, even when one role holds most of
    the work), then joined on (role, slot) — an equi-join whose keys spread
    over the roster.
    """
    from pacewise.operators.sequence import positions_within

    items = positions_within(work, [role_col], list(order), "_n")
    members = positions_within(roster.select(F.col(roster_role).alias("_role"), F.col(roster_member).alias("assigned_to")),
                               ["_role"], ["assigned_to"], "_slot")
    sizes = members.groupBy("_role").agg(F.count(F.lit(1)).alias("_size"))
    items = items.join(sizes, items[role_col] == sizes["_role"], "left").withColumn(
        "_slot", F.when(F.col("_size") > 0, F.col("_n") % F.col("_size"))).drop("_role", "_size")
    out = items.join(members, (F.col(role_col) == F.col("_role")) & (items["_slot"] == members["_slot"]), "left")
    return out.select(*work.columns, "assigned_to")
