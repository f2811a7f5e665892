"""Joins that keep a hot key of the large side apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 8


def spread_join(facts: DataFrame, dim: DataFrame, key: str, spread_by: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """``facts.join(dim, key, how)`` for a dimension with one row per key, dealt out by (key, salt).

    A fact's salt is a hash of ``spread_by`` (a column that differs from fact to
    fact); a dimension row goes to all salts. A key that holds a third of the
    facts therefore spans ``salts`` tasks, and since neither side is dealt out by
    (key, salt) before the join, both get an exchange of their own, which AQE's
    skew rule can split further. (A deduplicated dimension is already dealt out
    by its key: joined on that alone it has no exchange, and a hot key cannot be
    split.) ``how`` is inner, left, left_semi or left_anti.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)))
    copies = dim.withColumn("_salt", F.explode(F.array(*[F.lit(s).cast("long") for s in range(salts)])))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
