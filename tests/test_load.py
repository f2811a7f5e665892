"""Bulk load: every file once through crashes and failures; compaction follows the bytes; CSV headers."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.session import scratch_path
from pacewise.sources import csv as csvsrc
from pacewise.sources import sinks


def _land(spark, landing, name, n, start=0):
    spark.range(start, start + n).coalesce(1).write.mode("overwrite").parquet(f"{landing}/{name}")


def _load(spark, *paths, **options):
    return sinks.bulk_load_once(spark, *paths, "t", **options)


@pytest.fixture
def paths(spark):
    return [scratch_path(spark, n) for n in ("landing", "target", "manifest")]


def test_a_crash_between_data_and_manifest_loads_nothing_twice(spark, paths, monkeypatch):
    landing, target, manifest = paths
    _land(spark, landing, "a", 100)
    with monkeypatch.context() as m:
        record = sinks._record
        m.setattr(sinks, "_record", lambda files, at, *rest, **k: record(files, at, *rest, **k) if rest[3] == "pending" else (_ for _ in ()).throw(SystemExit))
        with pytest.raises(SystemExit):
            _load(spark, landing, target, manifest)
    assert {r.status for r in sinks.ingest_manifest(spark, manifest).collect()} == {"pending"}
    _land(spark, landing, "b", 50, 100)  # one more file lands before the retry
    assert _load(spark, landing, target, manifest) == 2
    assert _load(spark, landing, target, manifest) == 0
    got = sinks.loaded_rows(spark, target, manifest, "t")
    assert got.columns == ["id"] and sorted(r.id for r in got.collect()) == list(range(150))
    states = sinks.ingest_manifest(spark, manifest).collect()
    assert sorted((r.status, r.rows_loaded) for r in states) == [("success", 50), ("success", 100)]


def test_a_failed_batch_keeps_its_error_and_can_be_tried_again(spark, paths):
    import os

    landing, target, manifest = paths
    os.makedirs(landing)
    with open(f"{landing}/broken.parquet", "wb") as f:
        f.write(b"no parquet here")
    assert _load(spark, landing, target, manifest) == 0
    (state,) = sinks.ingest_manifest(spark, manifest).collect()
    assert state.status == "failed" and state.rows_loaded is None and state.error
    _land(spark, landing, "good", 10)
    assert _load(spark, landing, target, manifest) == 1  # the failed batch is left alone
    spark.range(3).coalesce(1).write.parquet(f"{landing}-mended")
    (part,) = [x for x in os.listdir(f"{landing}-mended") if x.endswith(".parquet")]
    with open(f"{landing}-mended/{part}", "rb") as src, open(f"{landing}/broken.parquet", "wb") as dst:
        dst.write(src.read())
    for junk in (f"{landing}/.broken.parquet.crc",):
        assert not os.path.exists(junk)
    assert _load(spark, landing, target, manifest, retry_failed=True) == 1
    assert {r.status for r in sinks.ingest_manifest(spark, manifest).collect()} == {"success"}
    assert sinks.loaded_rows(spark, target, manifest, "t").count() == 13


def test_files_are_taken_in_bounded_batches(spark, paths):
    landing, target, manifest = paths
    for k in range(5):
        _land(spark, landing, f"f{k}", 10, 10 * k)
    assert _load(spark, landing, target, manifest, files_per_batch=2) == 5
    assert sinks.ingest_manifest(spark, manifest).select("batch").distinct().count() == 3
    assert sinks.loaded_rows(spark, target, manifest, "t").count() == 50


def test_a_broken_manifest_is_an_error_not_an_empty_one(spark, paths):
    import os

    landing, target, manifest = paths
    _land(spark, landing, "a", 10)
    os.makedirs(manifest)
    with open(f"{manifest}/part-0.parquet", "wb") as f:
        f.write(b"no parquet here")
    with pytest.raises(Exception):
        _load(spark, landing, target, manifest)
    assert not os.path.exists(target)


def test_compaction_sizes_files_by_bytes_and_splits_a_hot_key(spark):
    source, path = scratch_path(spark, "small"), scratch_path(spark, "compacted")
    spark.range(20_000).selectExpr("CASE WHEN id % 10 < 6 THEN 'hot' ELSE concat('k', id % 50) END AS k", "id").write.parquet(source)
    size = sinks.list_files(spark, source).selectExpr("sum(length)").first()[0]
    n = sinks.compact_cluster(spark, source, path, ["k", "id"], file_bytes=size // 7)
    got = spark.read.parquet(path)
    files = got.selectExpr("_metadata.file_path AS f", "k").groupBy("f").count().collect()
    assert n in (7, 8) and len(files) == n and max(r["count"] for r in files) < 20_000 / 4
    assert got.exceptAll(spark.read.parquet(source)).isEmpty()


def test_csv_files_with_other_headers_load_by_name_or_raise(spark):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("qty", T.IntegerType())])
    one, two = scratch_path(spark, "csv-one"), scratch_path(spark, "csv-two")
    csvsrc.write_csv(spark.createDataFrame([(1, "x", 5)], "id long, name string, qty int").coalesce(1), one)
    csvsrc.write_csv(spark.createDataFrame([(2, "7", "y", "e")], "id long, qty string, name string, extra string").coalesce(1), two)
    want = [(1, "x", 5), (2, "y", 7)]
    assert sorted(map(tuple, csvsrc.read_csv_by_name(spark, [one, two], schema).collect())) == want
    both = scratch_path(spark, "csv-both")
    for src in (one, two):
        spark.read.text(src).coalesce(1).write.mode("append").text(both)
    with pytest.raises(Exception, match="(?i)header"):
        csvsrc.read_csv_by_name(spark, both, schema).collect()
    report = {r.column_name: (r.in_schema, r.in_file, r.failed_casts) for r in csvsrc.csv_header_report(spark, [one, two], schema).collect()}
    assert report == {"id": (True, True, 0), "name": (True, True, 0), "qty": (True, True, 0), "extra": (False, True, None)}
    bad = scratch_path(spark, "csv-bad")
    csvsrc.write_csv(spark.createDataFrame([("1", "many"), (None, "2")], "id string, qty string"), bad)
    report = {r.column_name: (r.in_schema, r.in_file, r.failed_casts) for r in csvsrc.csv_header_report(spark, bad, schema).collect()}
    assert report == {"id": (True, True, 0), "qty": (True, True, 1), "name": (True, False, None)}


def test_two_loads_at_once_give_each_row_once(spark, paths):
    from concurrent.futures import ThreadPoolExecutor

    landing, target, manifest = paths
    for k in range(6):
        _land(spark, landing, f"f{k}", 10, 10 * k)
    with ThreadPoolExecutor(2) as pool:
        taken = list(pool.map(lambda _: _load(spark, landing, target, manifest, files_per_batch=1), range(2)))
    assert sum(taken) == 6
    assert sorted(r.id for r in sinks.loaded_rows(spark, target, manifest, "t").collect()) == list(range(60))
    assert sinks.ingest_manifest(spark, manifest).where("status = 'success' AND attempt = 1").count() == 6


def test_a_live_load_keeps_its_batch_and_a_dead_ones_is_taken_over(spark, paths, monkeypatch):
    from pacewise.sources.claims import claim

    landing, target, manifest = paths
    _land(spark, landing, "a", 10)
    with monkeypatch.context() as m:
        m.setattr(sinks, "_load_batch", lambda *_: (_ for _ in ()).throw(SystemExit))
        with pytest.raises(SystemExit):
            _load(spark, landing, target, manifest)
    (batch,) = {r.batch for r in sinks.ingest_manifest(spark, manifest).collect()}
    live = claim(spark, f"{manifest}-claims/t/{batch}")
    assert _load(spark, landing, target, manifest) == 0  # another holds it
    assert claim(spark, live.path) is None
    assert _load(spark, landing, target, manifest, claim_seconds=-1) == 1  # taken for dead
    assert sinks.loaded_rows(spark, target, manifest, "t").count() == 10
    # The slow load comes to its end after all: an older attempt's outcome changes nothing.
    files = sinks.list_files(spark, landing).selectExpr("path AS file_path")
    sinks._load_batch(spark, files, batch, 1, target, manifest, "t", sinks.AS_OF)
    assert sinks.loaded_rows(spark, target, manifest, "t").count() == 10


def test_a_file_that_two_batches_hold_counts_once(spark, paths):
    landing, target, manifest = paths
    _land(spark, landing, "a", 10)
    _land(spark, landing, "b", 5, 10)
    assert _load(spark, landing, target, manifest) == 2
    files = sinks.list_files(spark, landing).selectExpr("path AS file_path").where("file_path LIKE '%/b/%'")
    sinks._load_batch(spark, files, "0" * 16, 1, target, manifest, "t", sinks.AS_OF)
    assert sorted(r.id for r in sinks.loaded_rows(spark, target, manifest, "t").collect()) == list(range(15))


def test_partitioned_loads_derive_silver_once(spark, monkeypatch):
    """The load and the re-load of a year take their rows from one written copy, not from the raw tables twice."""
    from pacewise.plans import maintenance as mt
    from tests.conftest import SF0001

    seen, real = [], sinks.write_partitioned
    monkeypatch.setattr(sinks, "write_partitioned", lambda df, *a, **k: (seen.append(df.inputFiles()), real(df, *a, **k))[1])
    out = mt.sink_partitioned_job(spark, SF0001)
    assert len(seen) == 2 and not [f for files in seen for f in files if "lineitem" in f]
    assert out.count() == out.select("delivery_id").distinct().count() == 4599


def test_compaction_of_well_packed_rows_bounds_what_a_task_sorts(spark, monkeypatch):
    """20 MB of texts that pack into a small file are sorted by several tasks."""
    monkeypatch.setattr(sinks.compact_cluster, "__defaults__", (sinks.FILE_BYTES, 4 << 20))
    source, path = scratch_path(spark, "packed"), scratch_path(spark, "packed-compacted")
    spark.range(20_000).selectExpr("id", "repeat('x', 1000) AS text").coalesce(1).write.parquet(source)
    n = sinks.compact_cluster(spark, source, path, ["id"])
    counts = [r["count"] for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()]
    assert len(counts) == n >= 5 and max(counts) < 20_000 / 3
    assert spark.read.parquet(path).exceptAll(spark.read.parquet(source)).isEmpty()
