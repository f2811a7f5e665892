"""Histories by batches, daily counts and as-of joins against windows and range joins on small data with hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pacewise.operators import history as h
from pacewise.operators.dedup import scd2_history
from pacewise.operators.sequence import running_sums
from pacewise.session import scratch_path
from pacewise.sources import sinks
from pacewise.sources.steps import Steps

VERSION = "k string, s string, t timestamp, n int"


def made_versions(seed, rows=400):
    rng, start = random.Random(seed), dt.datetime(1999, 1, 1)
    return [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice(["x", "y", None]), start + dt.timedelta(hours=rng.randrange(24 * 30)), i) for i in range(rows)]


def test_any_split_of_versions_gives_the_whole_history(spark):
    rows = made_versions(1)
    want = sorted(map(str, scd2_history(spark.createDataFrame(rows, VERSION), "k", "s", "t", ["n"]).collect()))
    for seed in (2, 3):
        parts = [[] for _ in range(3)]
        for r in rows:
            parts[random.Random(f"{seed}{r}").randrange(3)].append(r)
        base = scratch_path(spark, "history-test")
        for part in [*parts, parts[0], []]:
            got = h.merge_versions(spark.createDataFrame(part, VERSION), base, Steps(spark, scratch_path(spark, "history-steps")), "k", "s", "t", ("n",), buckets=4)
        assert sorted(map(str, got.collect())) == want


def test_a_merge_that_died_is_finished_and_other_buckets_stay(spark, monkeypatch):
    rows, base = made_versions(4, 60) + [(f"key-{i}", "x", dt.datetime(1999, 1, 1), i) for i in range(40)], scratch_path(spark, "history-test")
    frame = lambda part: spark.createDataFrame(part, VERSION)
    h.merge_versions(frame(rows), base, Steps(spark, scratch_path(spark, "history-steps")), "k", "s", "t", ("n",), buckets=16)
    before = {r.path for r in sinks.list_files(spark, base).collect()}
    late, steps, real, calls = [("key-7", "y", dt.datetime(1998, 1, 1), 99)], scratch_path(spark, "history-steps"), h.replace_partitions, []

    def dies(*args):
        if calls:
            raise RuntimeError("driver lost")
        calls.append(real(*args))

    monkeypatch.setattr(h, "replace_partitions", dies)
    with pytest.raises(RuntimeError):
        h.merge_versions(frame(late), base, Steps(spark, steps), "k", "s", "t", ("n",), buckets=16)
    monkeypatch.setattr(h, "replace_partitions", real)
    got = h.merge_versions(frame(late), base, Steps(spark, steps), "k", "s", "t", ("n",), buckets=16)
    want = scd2_history(frame(rows + late), "k", "s", "t", ["n"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    gone = before - {r.path for r in sinks.list_files(spark, base).collect()}
    assert gone and len({p.split("bucket=")[1].split("/")[0] for p in gone}) == 1


def test_running_sums_equal_a_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 7, F.lit("hot")).when(F.col("id") % 10 < 9, F.lit("w")).alias("g"),
                                  ((F.col("id") * 7919) % 100003).alias("o"), ((F.col("id") % 5) - 2).alias("v"))
    want = df.withColumn("r", F.sum("v").over(Window.partitionBy("g").orderBy("o")))
    assert sorted(map(str, running_sums(df, ["g"], ["o"], "v", "r").collect())) == sorted(map(str, want.collect()))
    assert running_sums(df.limit(0), ["g"], ["o"], "v", "r").collect() == []


def test_daily_counts_equal_the_intervals(spark):
    versions = scd2_history(spark.createDataFrame(made_versions(5), VERSION), "k", "s", "t", ["n"])
    kept, first, last = versions.collect(), dt.date(1999, 1, 5), dt.date(1999, 2, 10)
    got = {(r.s, r.day): r.active for r in h.active_by_day(versions, "s", first, last).collect()}
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    at = lambda d: dt.datetime(d.year, d.month, d.day)
    want = {(s, d): sum(r.s == s and r._valid_from <= at(d) and (r._valid_to is None or at(d) < r._valid_to) for r in kept)
            for s in {r.s for r in kept} for d in days}
    assert got == want


def test_facts_take_the_last_version_at_their_time(spark):
    rng, versions = random.Random(6), made_versions(7, 120)
    versions = list({(r[0], r[2]): r for r in versions}.values()) + [("hot", "late", None, 1)]
    facts = [(rng.choice(["hot", "hot", "a", "nobody", None]), None if i % 97 == 0 else dt.datetime(1998, 12, 25) + dt.timedelta(hours=rng.randrange(24 * 50)), i) for i in range(2000)]
    facts += facts[:5]
    got = h.as_of_join(spark.createDataFrame(facts, "k string, at timestamp, i int"), spark.createDataFrame(versions, VERSION), "k", "at", "t",
                       {"s": "s_then", "n": "n_then"})

    def last(k, at):
        known = [v for v in versions if k is not None and at is not None and v[0] == k and v[2] is not None and v[2] <= at]
        return (max(known, key=lambda v: v[2])[1], max(known, key=lambda v: v[2])[3]) if known else (None, None)

    assert got.columns == ["k", "at", "i", "s_then", "n_then"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((k, at, i, *last(k, at))) for k, at, i in facts)
