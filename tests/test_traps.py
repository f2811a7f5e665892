"""Trap cases: positional CSV binding, SQL NULL rules, NULL clamp, rounding, fail-fast expectations."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.functions.columns import round_half_up
from pacewise.functions.rules import Rule
from pacewise.operators import quality as qa
from pacewise.sources import csv as csvsrc


def test_csv_binds_by_header_name_not_position(spark):
    d = tempfile.mkdtemp(prefix="csv-shift-")
    # The file has an extra column inserted after brand_code, as the generator writes it.
    df = spark.createDataFrame([("C1", "dis", "DET", "Product", "1000.5")],
                               "campaign_id string, brand_code string, segment string, product string, "
                               "budget_usd string")
    csvsrc.write_csv(df, d)
    schema = T.StructType([T.StructField("campaign_id", T.StringType()), T.StructField("brand_code", T.StringType()),
                           T.StructField("product", T.StringType()), T.StructField("budget_usd", T.DoubleType())])
    positional = spark.read.option("header", "true").schema(schema).csv(d).first()
    assert positional.product == "DET"  # the silent shift a positional schema produces
    by_name = csvsrc.read_csv_by_name(spark, d, schema).first()
    assert by_name.product == "Product" and by_name.budget_usd == 1000.5
    report = {r.column_name: (r.in_schema, r.in_file) for r in csvsrc.csv_header_report(spark, d, schema).collect()}
    assert report == {"campaign_id": (True, True), "brand_code": (True, True), "product": (True, True),
                      "budget_usd": (True, True), "segment": (False, True)}


def test_null_rule_is_neither_pass_nor_fail(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    rules = [Rule("x_positive", "t", "x", "x > 0", "error")]
    r = qa.quality_report(df, "t", rules).first()
    assert (r.total_rows, r.passing_rows, r.failing_rows, r.null_rows) == (3, 1, 1, 1)
    from pacewise.functions import rules as R

    reg = [Rule("x_positive", "t", "x", "x > 0", "error")]
    assert qa.quarantine(df, "t", registry=reg).count() == 1
    assert qa.quarantine(df, "t", registry=reg, null_fails=True).count() == 2
    assert R.rules_for("t", reg) == reg


def test_greatest_clamp_turns_null_into_zero(spark):
    from pacewise.operators.clean import silver_delivery

    df = spark.createDataFrame(
        [("D1", "C1", dt.date(1999, 1, 1), None, -3, 0.5, -1.0, None, 0.5, dt.datetime(1999, 1, 2), "f")],
        "delivery_id string, campaign_id string, date date, impressions int, clicks int, ctr double, "
        "spend_usd double, vast_errors int, viewability_rate double, _ingested_at timestamp, _source_file string")
    r = silver_delivery(df).first()
    assert (r.impressions, r.clicks, r.spend_usd, r.vast_errors) == (0, 0, 0.0, 0)
    assert r.ctr == 0.0 and r.cpm is None


def test_half_up_rounding_is_portable(spark):
    r = spark.range(1).select(round_half_up(F.lit(1.005), 2).alias("a"), round_half_up(F.lit(2.5), 0).alias("b"),
                              round_half_up(F.lit(-0.125), 2).alias("c")).first()
    assert r.b == 3.0 and r.c == -0.12
    assert r.a in (1.0, 1.01)  # depends on the binary value of 1.005; identical in every IEEE engine


def test_expect_or_fail_raises(spark):
    df = spark.createDataFrame([("a",), (None,)], "id string")
    ok = qa.expect_or_fail(df.where(F.col("id").isNotNull()), [("has_id", "id IS NOT NULL", "fail")])
    assert ok.count() == 1
    with pytest.raises(Exception):
        qa.expect_or_fail(df, [("has_id", "id IS NOT NULL", "fail")]).collect()


def test_conversion_bodies_and_union_evolving(spark):
    from pacewise.operators import conversions as cv
    from pacewise.session import cut_lineage
    from pacewise.sources.sinks import union_evolving

    ev = spark.createDataFrame(
        [("meta", "Purchase", "evt_1", dt.datetime(2024, 1, 1), "browser", " A@B.com ", None, "1.1.1.1", "ua", 1.0,
          "USD"),
         ("pinterest", "Purchase", "evt_2", dt.datetime(2024, 1, 1), "browser", "x", "1", "ip", "ua", 2.0, "USD")],
        "publisher string, event_name string, event_id string, event_time timestamp, source_channel string, "
        "email string, phone string, ip_address string, user_agent string, value double, currency string")
    p = cv.conversion_payloads(ev)
    assert {r.route for r in p.collect()} == {"meta", "rejected"}
    body = cv.conversion_bodies(p).first().body
    import hashlib

    assert hashlib.sha256(b"a@b.com").hexdigest() in body and '"ph":[""]' in body
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "n")], "x int, y string")
    u = cut_lineage(union_evolving(a, b))
    assert sorted((r.x, r.y) for r in u.collect()) == [(1, None), (2, "n")]


def test_rounding_is_identical_in_spark_and_duckdb(spark):
    import random

    import duckdb

    from pacewise.oracle import rnd

    rng = random.Random(7)
    vals = [rng.uniform(-1e6, 1e6) for _ in range(500)] + [rng.randint(-10**6, 10**6) / 1000 + 0.0005
                                                           for _ in range(500)]
    vals += [1.005, 2.675, -0.125, 0.5, -0.5, 1e-7, 123456.78949999999]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = {r.i: (r.r2, r.r4) for r in df.select("i", round_half_up("x", 2).alias("r2"),
                                                round_half_up("x", 4).alias("r4")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(vals)))
    want = {i: (a, b) for i, a, b in con.execute(f"SELECT i, {rnd('x', 2)}, {rnd('x', 4)} FROM t").fetchall()}
    assert got == want


def test_calendar_week_ago_is_a_day_not_a_row_and_none_without_a_date(spark):
    from pacewise.plans import gold

    cols = ("campaign_id string, delivery_date date, impressions int, clicks int, spend_usd double, vast_errors int, "
            "viewability_rate double, cpm double, cpc double, ctr double, _suspicious_ctr boolean")
    day = lambda d: d and dt.date(1999, 6, d)
    rows = [("C", day(d), n, 0, 1.0, 0, 0.5, 1.0, 1.0, 0.1, False) for d, n in [(1, 10), (2, 20), (8, 30), (9, None), (15, 40), (16, 5), (None, 7)]]
    campaigns = spark.createDataFrame([("C", "Meta")], "campaign_id string, platform string")
    got = gold.daily_ops_summary(spark.createDataFrame(rows, cols), campaigns, calendar=True).collect()
    ago = {r.delivery_date and r.delivery_date.day: r.impressions_7d_ago for r in got}
    assert ago == {1: None, 2: None, 8: 10, 9: 20, 15: 30, 16: None, None: None}
