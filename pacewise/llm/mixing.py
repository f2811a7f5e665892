"""Mixing sources to target weights.

Tokens are aggregated per source, the targets give each source a repetition
rate, and each document is emitted floor(rate) times plus one more copy when a
hash of its doc_id falls below the rate's fraction. Every decision is a function
of the document and its source's rate, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pacewise.llm.common import look_up, stage, whole_row, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes. A source stops at ``most`` times its size and its
    excess is shared again by weight. The fixed point of that is a water level:
    with sources ordered by cap per weight, the first k are at their caps and
    the rest get weight times ``level``. The windows see one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int"))
    capped = per.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    order = [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()]
    below = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    steps = capped.select(
        "*", (F.sum("source_size").over(everything).cast("double") * share).alias("goal"),
        F.coalesce(F.sum("cap").over(below), F.lit(0)).alias("filled"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0))).alias("left"))
    # The level if all earlier sources (in order) are full and this one and the later are not.
    leveled = steps.withColumn("at", (F.col("goal") - F.col("filled")) / F.col("left"))
    open_ = F.col("at") * F.col("w") <= F.col("cap")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("w"), F.col("at")))).over(everything)["at"]
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("w") * level, F.col("cap").cast("double")))
    return leveled.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A uniform number in [0, 1) from 52 bits of an MD5 of seed and doc_id."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(rate: Column, doc_id: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(draw(doc_id) < rate - whole, 1).otherwise(0)).cast("int")


def mix_counts(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs`` (doc_id, text, source).

    A null or empty text has size 0 and takes 0 words. Null doc_ids share one
    draw; repeated rows share theirs. Sources of size 0 have target 0.
    """
    sized = stage(docs.select("doc_id", "source", word_count().alias("size")), "sizes")
    rated = look_up(sized, source_targets(sized.select("source", "size")), "source")
    return rated.select("doc_id", "size", "source_size", "target",
                        (F.col("size") * copies(F.col("rate"), F.col("doc_id"))).cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with all its columns and no others."""
    targets = source_targets(docs.select("source", word_count().alias("size")))
    rows = docs.select(whole_row(docs), "doc_id", "source")
    rated = look_up(rows, targets, "source")
    times = F.sequence(F.lit(1), copies(F.col("rate"), F.col("doc_id")))
    return (rated.where(copies(F.col("rate"), F.col("doc_id")) > 0).select("_row", F.explode(times).alias("_copy"))
            .select("_row.*"))
