"""Gold from changed days: the rebuild's rows, no untouched day read, and any death of a run mended by the next."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.operators import clean
from pacewise.plans import delta_gold, gold
from pacewise.session import DROP_SHUFFLES, scratch_path, shuffles_dropped
from pacewise.sources import bindings as b
from pacewise.sources import steps as st
from pacewise.streaming import ingest
from tests.conftest import SF0001

COLS = ("delivery_id string, campaign_id string, date date, impressions int, clicks int, ctr double, spend_usd double, vast_errors int, "
        "viewability_rate double, _ingested_at timestamp, _source_file string, _batch_id string, _src_partkey long, _src_suppkey long")


def batch(spark, rows):
    """(delivery, campaign, day of June or None, impressions, hour of ingestion)."""
    day = lambda d: dt.date(1999, 6, d) if d else None
    return spark.createDataFrame([(k, c, day(d), n, None if n is None else n // 7, 0.01, n and n / 8, 1, 0.5, dt.datetime(1999, 6, 29, at), "f", "b", 1, 1)
                                  for k, c, d, n, at in rows], COLS)


@pytest.fixture(scope="module")
def campaigns(spark):
    c = clean.silver_campaigns(b.campaigns_bronze(spark, SF0001), AS_OF).orderBy("campaign_id").limit(12)
    return spark.createDataFrame(c.collect(), c.schema)


def run(spark, rows, campaigns, home, epoch, as_of=AS_OF):
    job = st.Steps(spark, f"{home}/steps/epoch={epoch}")
    if job.done():
        return []
    days = ingest.merge_delivery(spark, batch(spark, rows), f"{home}/silver", as_of, job)
    changed = delta_gold.refresh_totals(spark, job, days, f"{home}/gold", 8)
    found = delta_gold.refresh_performance(spark, campaigns, f"{home}/gold", as_of, changed, 8)
    job.finish()
    return found


def rebuilt(spark, campaigns, home, as_of=AS_OF):
    return gold.campaign_performance(campaigns, ingest.read_delivery(spark, f"{home}/silver"), as_of)


def same(a, c):
    left, right = [tuple(r) for r in a.select(sorted(a.columns)).collect()], [tuple(r) for r in c.select(sorted(c.columns)).collect()]
    assert sorted(left, key=str) == sorted(right, key=str) and len(left) > 0


def versions(ids, n, seed):
    """Rows of ``n`` epochs: deliveries come again, move to another day or campaign, or lose to an older version."""
    rng = random.Random(seed)
    return [[(f"d{rng.randrange(40)}", rng.choice(ids), rng.choice([None, *range(1, 29)]), rng.choice([None, 0, *range(1, 5_000)]), rng.randrange(24))
             for _ in range(25)] for _ in range(n)]


def test_any_sequence_of_batches_equals_the_rebuild(spark, campaigns):
    ids, home = [r[0] for r in campaigns.select("campaign_id").collect()], scratch_path(spark, "t-delta")
    for epoch, rows in enumerate(versions([*ids[:7], "unknown"], 4, 5)):
        run(spark, rows, campaigns, home, epoch)
        same(delta_gold.read_performance(spark, f"{home}/gold"), rebuilt(spark, campaigns, home))


def test_days_that_lose_all_rows_move_first_and_last(spark, campaigns):
    one = campaigns.first()["campaign_id"]
    home = scratch_path(spark, "t-ends")
    run(spark, [("a", one, 1, 10, 1), ("b", one, 9, 20, 1), ("c", one, 20, 30, 1)], campaigns, home, 0)
    for epoch, rows in enumerate([[("a", one, 5, 10, 2)], [("c", one, 6, 30, 2)], [("a", "other", 5, 10, 3), ("b", "other", 9, 1, 3)], [("c", "other", 6, 1, 3)]], 1):
        run(spark, rows, campaigns, home, epoch)
        same(delta_gold.read_performance(spark, f"{home}/gold"), rebuilt(spark, campaigns, home))
    assert spark.read.parquet(f"{home}/gold/totals").where(F.col("campaign_id") == one).isEmpty()


def test_untouched_days_and_buckets_are_neither_read_nor_written(spark, campaigns):
    ids, home = [r[0] for r in campaigns.select("campaign_id").collect()], scratch_path(spark, "t-untouched")
    run(spark, [(f"d{i}", ids[i % 6], 1 + i, 100 + i, 1) for i in range(12)], campaigns, home, 0)
    files = lambda t: {r.f for r in spark.read.parquet(f"{home}/{t}").select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    before = {t: files(t) for t in ("silver", "gold/totals", "gold/performance")}
    # Days 2 to 12 cannot be read any more: the run must not want to.
    hidden = [f.removeprefix("file:") for f in before["silver"] if "1999-06-01" not in f]
    kept = {f: open(f, "rb").read() for f in hidden}
    for f in hidden:
        open(f, "wb").write(b"not a parquet file")
        st.delete(spark, f.rsplit("/", 1)[0] + "/." + f.rsplit("/", 1)[1] + ".crc")
    buckets = run(spark, [("new", ids[0], 1, 999, 2), ("late", ids[0], 15, 7, 2)], campaigns, home, 1)
    for f, raw in kept.items():
        open(f, "wb").write(raw)
    assert len(buckets) == 1
    for t, column in (("silver", "1999-06-01"), ("gold/totals", f"bucket={buckets[0]}/"), ("gold/performance", f"bucket={buckets[0]}/")):
        assert {f for f in before[t] if column not in f} == {f for f in files(t) if column not in f and "1999-06-15" not in f}, t
    same(delta_gold.read_performance(spark, f"{home}/gold"), rebuilt(spark, campaigns, home))


def test_a_new_day_and_changed_campaigns_are_finished(spark, campaigns):
    ids, home = [r[0] for r in campaigns.select("campaign_id").collect()], scratch_path(spark, "t-dims")
    run(spark, [(f"d{i}", ids[i], 20 + i % 8, 100 + i, 1) for i in range(10)], campaigns, home, 0)
    base, other = f"{home}/gold", campaigns.where(F.col("campaign_id") != ids[3]).withColumn(
        "budget_usd", F.when(F.col("campaign_id") == ids[5], F.lit(17.0)).otherwise(F.col("budget_usd")))
    assert 0 < len(delta_gold.refresh_performance(spark, other, base, AS_OF, [], 8)) <= 2
    same(delta_gold.read_performance(spark, base), rebuilt(spark, other, home))
    assert delta_gold.refresh_performance(spark, other, base, AS_OF, [], 8) == []
    later = AS_OF + dt.timedelta(days=5)
    assert len(delta_gold.refresh_performance(spark, other, base, later, [], 8)) == 8
    same(delta_gold.read_performance(spark, base), rebuilt(spark, other, home, later))


class Died(Exception):
    pass


@pytest.mark.parametrize("write", range(1, 5))
def test_a_run_that_dies_while_it_replaces_partitions_is_finished_by_the_next(spark, campaigns, monkeypatch, write):
    """The ``write``-th table's partitions are gone but for one, which is new, when the run dies."""
    ids, home = [r[0] for r in campaigns.select("campaign_id").collect()], scratch_path(spark, "t-died")
    run(spark, [(f"d{i}", ids[i % 7], 1 + i, 100 + i, 1) for i in range(12)], campaigns, home, 0)
    rows = [("d0", ids[1], 2, 5, 2), ("d3", ids[2], 9, 6, 2), ("n1", ids[3], 5, 7, 2), ("n2", ids[4], 28, 8, 2)]
    count, real = [0], st.replace_partitions

    def half(frame, path, column, values):
        count[0] += 1
        if count[0] < write:
            return real(frame, path, column, values)
        values = sorted(values, key=str)
        for v in values:  # a dynamic overwrite removes a partition before it moves the new one in
            st.delete(spark, f"{path}/{column}={v}")
        real(frame.where(F.col(column) == F.lit(values[0])), path, column, [])
        raise Died

    for module in (ingest, delta_gold):
        monkeypatch.setattr(module, "replace_partitions", half)
    with pytest.raises(Died):
        run(spark, rows, campaigns, home, 1)
    monkeypatch.undo()
    run(spark, rows, campaigns, home, 1)
    got = {(r.delivery_id, str(r.delivery_date), r.impressions) for r in ingest.read_delivery(spark, f"{home}/silver").collect()}
    assert got == {(f"d{i}", f"1999-06-{1 + i:02d}", 100 + i) for i in range(12) if i not in (0, 3)} | {
        ("d0", "1999-06-02", 5), ("d3", "1999-06-09", 6), ("n1", "1999-06-05", 7), ("n2", "1999-06-28", 8)}
    same(delta_gold.read_performance(spark, f"{home}/gold"), rebuilt(spark, campaigns, home))
    assert run(spark, rows, campaigns, home, 1) == []  # done: a replay changes nothing


def test_an_epoch_writes_rows_once_before_they_replace_and_deals_them_once_by_key(spark, campaigns, monkeypatch):
    """No deduplicated copy of the batch, no copy of the new partials, one exchange for a campaign's changes; repeats in a batch count once."""
    ids, home, names, plans, real = [r[0] for r in campaigns.select("campaign_id").collect()], scratch_path(spark, "t-once"), [], {}, st.Steps.table

    def table(self, name, build):
        names.append(name)
        plans[name] = build()._jdf.queryExecution().sparkPlan().toString(), build()._jdf.queryExecution().executedPlan().toString()
        return real(self, name, build)

    monkeypatch.setattr(st.Steps, "table", table)
    run(spark, [("a", ids[0], 3, 10, 1), ("a", ids[0], 4, 11, 2), ("a", ids[1], 5, 12, 0), ("b", ids[1], 5, 7, 1)], campaigns, home, 0)
    assert set(names) == {"days", "merged", "partials", "changes", "totals"}
    assert plans["changes"][1].count("Exchange ") == 1 and plans["merged"][1].count("Exchange ") == 1
    assert {(r.delivery_id, str(r.delivery_date)) for r in ingest.key_days(spark, f"{home}/silver-keys").collect()} == {("a", "1999-06-04"), ("b", "1999-06-05")}
    assert ingest.read_delivery(spark, f"{home}/silver").count() == 2 and ingest.ARRIVED not in spark.read.parquet(f"{home}/silver").columns
    run(spark, [("b", ids[1], 6, 8, 2)], campaigns, home, 1)
    same(delta_gold.read_performance(spark, f"{home}/gold"), rebuilt(spark, campaigns, home))


def test_landed_years_move_and_are_not_written_again(spark):
    from pacewise.plans import maintenance as mt

    src, _ = mt._land_delivery(spark, SF0001, "t-move-src")
    landing, years = scratch_path(spark, "t-move-landing"), mt._years(spark, src)
    n, names = spark.read.parquet(src).count(), {p.split("/")[-1] for p in spark.read.parquet(src).inputFiles()}
    mt._land_years(spark, years, landing)
    assert spark.read.parquet(landing).count() == n
    assert {p.split("/")[-1] for p in spark.read.parquet(landing).inputFiles()} == names


def test_partials_are_dealt_out_once_and_only_changed_campaigns_go_on(spark, campaigns, monkeypatch):
    ids, home, told, plans, dealt = [r[0] for r in campaigns.select("campaign_id").collect()], scratch_path(spark, "t-changed"), {}, {}, {}
    run(spark, [("a", ids[0], 3, 10, 1), ("b", ids[1], 3, 7, 1), ("c", ids[2], 9, 7, 1), ("d", ids[3], 3, 5, 1)], campaigns, home, 0)
    table, write = st.Steps.table, st.write_partitioned

    def noted(self, name, build):
        plans[name], out = build()._jdf.queryExecution().executedPlan().toString(), table(self, name, build)
        told[name] = out
        if name == "changes":
            told[name] = {r["campaign_id"]: (r["days"], r["impressions"], str(r["first_new"]), str(r["first_lost"])) for r in out.collect()}
        return out

    def written(rows, path, column, mode="overwrite", **more):
        dealt[column] = more.get("dealt", False)
        write(rows, path, column, mode, **more)

    monkeypatch.setattr(st.Steps, "table", noted)
    monkeypatch.setattr(st, "write_partitioned", written)
    run(spark, [("a", ids[0], 3, 14, 2), ("d", ids[3], 5, 6, 2), ("e", ids[4], None, 8, 2)], campaigns, home, 1)
    # On day 3, b is as it was: its campaign has nothing to carry into the totals.
    assert told["changes"] == {ids[0]: (0, 4, "1999-06-03", "None"), ids[3]: (0, 1, "1999-06-05", "1999-06-03"), ids[4]: (1, 8, "None", "None")}
    assert plans["partials"].count("Exchange ") == plans["partials"].count("Exchange rangepartitioning") == 1
    assert dealt == {"delivery_date": False, "month": True, "bucket": False}
    same(delta_gold.read_performance(spark, f"{home}/gold"), rebuilt(spark, campaigns, home))


def test_shuffle_files_go_with_their_step_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.unset(DROP_SHUFFLES)
    with shuffles_dropped(spark):
        assert spark.conf.get(DROP_SHUFFLES) == "true"
    assert spark.conf.get(DROP_SHUFFLES, None) is None
    spark.conf.set(DROP_SHUFFLES, "false")
    with shuffles_dropped(spark):
        assert spark.conf.get(DROP_SHUFFLES) == "false"
    spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
