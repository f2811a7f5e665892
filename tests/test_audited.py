"""Audited writes and published lookups."""

import glob
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pacewise.plans import lookup
from pacewise.session import scratch_path
from pacewise.sources.audited import AuditedTable, measured
from pacewise.sources.steps import Steps

RULES = [("has_id", "id IS NOT NULL", "fail"), ("positive", "n > 0", "drop"), ("small", "n < 10", "keep")]


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, n int")


def _report(table, load):
    return {r.expectation: (r.total_rows, r.failed_records, r.written_rows, r.passed) for r in table.report().where(F.col("load") == load).collect()}


def test_a_refused_load_changes_nothing_and_leaves_its_counts(spark):
    table = AuditedTable(spark, scratch_path(spark, "t-audit"))
    assert table.append(_rows(spark, ("a", 1), ("b", 0), ("c", None), ("d", 50)), "one", RULES)
    before = sorted(glob.glob(f"{table.path}/**/*.parquet", recursive=True))
    assert not table.append(_rows(spark, (None, 1), ("e", 2)), "two", RULES)
    assert sorted(glob.glob(f"{table.path}/**/*.parquet", recursive=True)) == before
    assert {(r.id, r.n) for r in table.rows().collect()} == {("a", 1), ("d", 50)}  # NULL breaks a drop rule, not a keep rule
    assert _report(table, "one") == {"has_id": (4, 0, 2, True), "positive": (4, 2, 2, True), "small": (4, 1, 2, True)}
    assert _report(table, "two") == {"has_id": (2, 1, 0, False), "positive": (2, 0, 0, False), "small": (2, 0, 0, False)}
    assert table.append(_rows(spark, ("f", 3), ("e", 2)), "two", RULES)  # mended and loaded again
    assert table.append(_rows(spark, ("f", 3), ("e", 2)), "two", RULES)  # repeated
    assert table.rows().count() == 4 and _report(table, "two")["has_id"] == (2, 0, 2, True)


def test_a_load_that_died_before_its_rename_is_written_anew(spark, monkeypatch):
    from pacewise.sources import audited

    table = AuditedTable(spark, scratch_path(spark, "t-audit-dead"))
    table.append(_rows(spark, ("a", 1)), "one", RULES)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(audited, "rename_new", die)
        with pytest.raises(KeyboardInterrupt):
            table.append(_rows(spark, ("b", 2)), "two", RULES)
    assert table.rows().count() == 1
    assert table.append(_rows(spark, ("b", 2)), "two", RULES) and table.rows().count() == 2
    assert table.report().where("load = 'two'").count() == len(RULES)


def test_counts_come_from_the_write_itself(spark):
    """One scan of the source, and the counting stands in the write's last stage, above every exchange."""
    src = scratch_path(spark, "t-audit-src")
    _rows(spark, *[(str(i), i % 7) for i in range(1000)]).write.parquet(src)
    rows, seen = measured(spark.read.parquet(src).groupBy("id").agg(F.max("n").alias("n")), RULES)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.index("CollectMetrics") < plan.index("Exchange")
    rows.write.parquet(scratch_path(spark, "t-audit-out"))
    assert seen.get["total_rows"] == 1000 and seen.get["failed_1"] == sum(i % 7 == 0 for i in range(1000))


def test_an_empty_load(spark):
    table = AuditedTable(spark, scratch_path(spark, "t-audit-empty"))
    assert table.append(_rows(spark, ("a", 1)).where("n > 5"), "none", RULES)
    assert table.rows().count() == 0 and _report(table, "none")["has_id"] == (0, 0, 0, True)
    with pytest.raises(ValueError):
        table.append(_rows(spark, ("a", 1)), "../x", RULES)


def _scanned(df):
    """Rows and files that the scans of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    out = []
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        out.append((m.apply("numOutputRows").value(), m.apply("numFiles").value()))
    return out


def test_a_lookup_reads_one_row_group_of_one_file(spark):
    path = scratch_path(spark, "t-lookup")
    df = spark.range(200_000).select(F.format_string("K%07d", F.col("id") * 2).alias("k"), (F.col("id") % 100).alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    lookup.publish(df, path, "k", buckets=4, row_group_bytes=256 << 10)
    files = glob.glob(f"{path}/_bucket=*/*.parquet")
    groups = [pq.ParquetFile(f).metadata for f in files]
    assert len(files) == 4 and all(g.num_row_groups > 3 for g in groups)
    biggest = max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups))
    hit = lookup.look_up(spark, path, "k", "K0123456")
    plan = hit._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and "PushedFilters: [" in plan
    (rows, n_files), = _scanned(hit)
    assert n_files == 1 and 1 <= rows <= biggest
    assert [(r.k, r.v) for r in hit.collect()] == [("K0123456", 61728 % 100)]
    miss = lookup.look_up(spark, path, "k", "K0123457")  # between two keys: only the bloom filter rules it out
    (rows, n_files), = _scanned(miss)
    assert n_files == 1 and rows == 0 and miss.count() == 0


def test_refresh_rewrites_the_changed_keys_buckets(spark):
    path = scratch_path(spark, "t-lookup-refresh")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v int")
    lookup.publish(rows(*[(f"k{i}", i) for i in range(50)], (None, -1)), path, "k", buckets=8)
    before = {f: os.path.getmtime(f) for f in glob.glob(f"{path}/_bucket=*/*.parquet")}
    steps = Steps(spark, scratch_path(spark, "t-lookup-steps"))
    touched = lookup.refresh(rows(("k7", 70), ("k7", 71), ("new", 1), (None, -2)), path, "k", steps)
    assert lookup.refresh(rows(("k7", 70), ("k7", 71), ("new", 1), (None, -2)), path, "k", steps) == touched  # repeated
    kept = {f for f in before if not any(f"/_bucket={t}/" in f for t in touched)}
    assert kept and kept <= set(glob.glob(f"{path}/_bucket=*/*.parquet"))
    find = lambda k: sorted(r.v for r in lookup.look_up(spark, path, "k", k).collect())
    assert (find("k7"), find("new"), find(None), find("k8"), find("k9999")) == ([70, 71], [1], [-2], [8], [])
    assert lookup.refresh(rows(("x", 1)).where("v > 1"), path, "k", Steps(spark, scratch_path(spark, "t-lookup-none"))) == []
    with pytest.raises(ValueError):
        lookup.publish(rows(("a", 1)), path, "k", buckets=8)
