"""Streaming restart safety: reruns on the same checkpoint add only new files and never duplicate rows."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.operators import clean
from pacewise.plans import maintenance as mt
from pacewise.session import scratch_path
from pacewise.sources import bindings as b
from pacewise.streaming import ingest
from tests.conftest import SF0001


def test_refresh_rerun_is_idempotent_and_complete(spark):
    src, schema = mt._land_delivery(spark, SF0001, "t-refresh-src")
    schema = schema.add("ship_year", T.IntegerType())
    landing = scratch_path(spark, "t-refresh-landing")
    bronze, silver, ckpt = (scratch_path(spark, n) for n in ("t-b", "t-s", "t-c"))
    years = mt._years(spark, src)
    for y in years[:2]:
        spark.read.parquet(y).write.mode("append").parquet(f"{landing}/{y.rsplit('/', 1)[1]}")
    ingest.refresh_delivery(spark, landing, schema, bronze, silver, ckpt)
    first = spark.read.parquet(silver).count()
    ingest.refresh_delivery(spark, landing, schema, bronze, silver, ckpt)  # nothing new
    assert spark.read.parquet(silver).count() == first
    for y in years[2:]:
        spark.read.parquet(y).write.mode("append").parquet(f"{landing}/{y.rsplit('/', 1)[1]}")
    ingest.refresh_delivery(spark, landing, schema, bronze, silver, ckpt)
    got = ingest.read_delivery(spark, silver)
    want = clean.silver_delivery(b.delivery_bronze(spark, SF0001))
    assert got.count() == want.count()
    assert got.select(*want.columns).exceptAll(want).count() == 0


def _rows(spark, *rows):
    import datetime as dt

    cols = "delivery_id string, campaign_id string, date date, impressions int, clicks int, ctr double, spend_usd double, vast_errors int, " \
           "viewability_rate double, _ingested_at timestamp, _source_file string, _batch_id string, _src_partkey long, _src_suppkey long"
    return spark.createDataFrame([(k, "C", dt.date(1999, 1, day) if day else None, n, 0, 0.5, 1.0, 0, 0.5, dt.datetime(1999, 2, at), "f", "b", 1, 1)
                                  for k, day, n, at in rows], cols)


def test_a_batch_rewrites_only_its_days(spark):
    silver = scratch_path(spark, "t-days")
    ingest.merge_delivery(spark, _rows(spark, ("a", 1, 1, 1), ("b", 2, 2, 1), ("c", 3, 3, 1), ("d", 4, 4, 1), ("n", None, 9, 1)), silver)
    files = lambda: {(r.d, r.f) for r in spark.read.parquet(silver).select(
        F.col("delivery_date").cast("string").alias("d"), F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = files()
    # a stays on its day, b moves to day 3 and leaves day 2 empty, an older c loses, e is new
    days = ingest.merge_delivery(spark, _rows(spark, ("a", 1, 10, 2), ("b", 3, 20, 2), ("c", 3, 30, 1), ("e", 1, 50, 2)), silver)
    assert {str(d) for d in days} == {"1999-01-01", "1999-01-02", "1999-01-03"}
    after = files()
    assert {x for x in before if x[0] in ("1999-01-04", None)} == {x for x in after if x[0] in ("1999-01-04", None)}
    assert not {x[1] for x in before if x[0] in ("1999-01-01", "1999-01-03")} & {x[1] for x in after}
    got = {(r.delivery_id, str(r.delivery_date), r.impressions) for r in ingest.read_delivery(spark, silver).collect()}
    assert got - {("c", "1999-01-03", 3), ("c", "1999-01-03", 30)} == {
        ("a", "1999-01-01", 10), ("b", "1999-01-03", 20), ("d", "1999-01-04", 4), ("e", "1999-01-01", 50), ("n", "None", 9)}
    assert "1999-01-02" not in {x[0] for x in after} and len(got) == 6
    ingest.merge_delivery(spark, _rows(spark, ("a", 1, 10, 2), ("b", 3, 20, 2)), silver)  # replayed
    assert {(r.delivery_id, r.impressions) for r in ingest.read_delivery(spark, silver).collect()} == {(k, n) for k, _, n in got}


def test_stream_dedup_keeps_one_copy_per_event(spark):
    out = mt.stream_conversion_dedup_job(spark, SF0001)
    assert out.count() == out.select("publisher", "event_id").distinct().count()
    assert out.count() == b.conversion_events(spark, SF0001).select("publisher", "event_id").distinct().count()
    assert out.where(F.col("event_id").isNull()).count() == 0


def test_csv_stream_rejects_shifted_header(spark):
    import pytest

    from pacewise.sources import csv as csvsrc

    landing = scratch_path(spark, "t-csv-shift")
    spark.createDataFrame([("C1", "dis", "DET", "1.5")], "campaign_id string, brand_code string, segment string, "
                          "budget_usd string").transform(lambda d: csvsrc.write_csv(d, landing) or d)
    schema = T.StructType([T.StructField("campaign_id", T.StringType()), T.StructField("brand_code", T.StringType()),
                           T.StructField("budget_usd", T.DoubleType())])
    with pytest.raises(Exception):
        ingest.stream_files(spark, landing, schema, scratch_path(spark, "t-csv-sink"), scratch_path(spark, "t-csv-ck"),
                            fmt="csv")


def test_csv_landing_shuffles_rows_for_the_join_only(spark, monkeypatch):
    from pacewise.sources import csv as csvsrc

    plans, real = [], csvsrc.write_csv
    monkeypatch.setattr(csvsrc, "write_csv", lambda df, *a: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, *a))[1])
    out = mt.stream_ingest_csv_job(spark, SF0001)
    assert len(plans) == 1 and "Rebalance" not in plans[0]
    assert out.count() == b.delivery_bronze(spark, SF0001).count()
