"""Data-quality operators: expectations, per-check reports, scoreboard, health, quarantine.

Every report is ONE pass over its table: each rule becomes a pair of
conditional sums in a single global aggregate (partial per task, one final
row), then the per-rule columns are unpivoted with ``explode(array(struct))``.
SQL NULL semantics are kept: a rule evaluating to NULL neither passes nor
fails; its count is reported as ``null_rows``.
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.config import AS_OF
from pacewise.functions.columns import as_of_ts, round_half_up
from pacewise.functions.rules import QUARANTINE_RULES, SCOREBOARD_CHECKS, Rule, rules_for


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")


def quality_report(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """Q-04: one row per check with total, passing, failing, null and pass %."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for i, r in enumerate(rules):
        cond = F.expr(r.predicate)
        aggs += [_cnt(cond).alias(f"p{i}"), _cnt(~cond).alias(f"f{i}")]
    g = df.agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(r.name).alias("check_name"), F.lit(r.severity).alias("severity"),
                 F.lit(r.column).alias("column_name"), F.col(f"p{i}").alias("passing_rows"),
                 F.col(f"f{i}").alias("failing_rows"))
        for i, r in enumerate(rules)
    ])
    x = g.select("total_rows", F.explode(items).alias("c")).select(
        F.lit(table).alias("table_name"), "c.check_name", "c.severity", "c.column_name", "total_rows",
        "c.passing_rows", "c.failing_rows")
    n = F.col("total_rows")
    return x.select(
        "*",
        (n - F.col("passing_rows") - F.col("failing_rows")).alias("null_rows"),
        F.when(n > 0, round_half_up(F.col("passing_rows") * F.lit(100.0) / n, 4)).alias("pass_rate_pct"),
    )


def table_health(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """Q-06: per table — rows passing every check, rows failing an error check, warn checks with failures,
    pass rate, and healthy iff no error-level check has a failing row."""
    all_pass = reduce(lambda a, b: a & b, [F.coalesce(F.expr(r.predicate), F.lit(False)) for r in rules])
    errors = [r for r in rules if r.severity == "error"]
    warns = [r for r in rules if r.severity == "warn"]
    any_err = reduce(lambda a, b: a | b, [F.coalesce(~F.expr(r.predicate), F.lit(False)) for r in errors]) \
        if errors else F.lit(False)
    aggs = [F.count(F.lit(1)).alias("total_rows"), _cnt(all_pass).alias("passed_rows"),
            _cnt(any_err).alias("failed_rows")]
    aggs += [_cnt(~F.expr(r.predicate)).alias(f"e{i}") for i, r in enumerate(errors)]
    aggs += [_cnt(~F.expr(r.predicate)).alias(f"w{i}") for i, r in enumerate(warns)]
    g = df.agg(*aggs)
    warn_count = reduce(lambda a, b: a + b, [F.when(F.col(f"w{i}") > 0, 1).otherwise(0) for i in range(len(warns))],
                        F.lit(0))
    healthy = reduce(lambda a, b: a & b, [F.col(f"e{i}") == 0 for i in range(len(errors))], F.lit(True))
    n = F.col("total_rows")
    return g.select(
        F.lit(table).alias("table_name"), "total_rows", "passed_rows", "failed_rows",
        warn_count.cast("long").alias("warnings"),
        F.when(n > 0, round_half_up(F.col("passed_rows") * F.lit(100.0) / n, 2)).otherwise(F.lit(0.0))
        .alias("pass_rate"),
        healthy.alias("is_healthy"),
    )


def quality_scoreboard(tables: dict[str, DataFrame], as_of: _dt.datetime = AS_OF) -> DataFrame:
    """Q-05: long form (table_name, total_rows, check_name, valid_rows), one pass per table."""
    parts = []
    for table, df in tables.items():
        checks = SCOREBOARD_CHECKS[table]
        g = df.agg(F.count(F.lit(1)).alias("total_rows"),
                   *[_cnt(F.expr(p)).alias(f"v{i}") for i, (_, p) in enumerate(checks)])
        items = F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(f"v{i}").alias("valid_rows"))
                          for i, (name, _) in enumerate(checks)])
        parts.append(g.select(as_of_ts(as_of).alias("check_run_at"), F.lit(table).alias("table_name"),
                              "total_rows", F.explode(items).alias("c"))
                     .select("check_run_at", "table_name", "total_rows", "c.check_name", "c.valid_rows"))
    return reduce(DataFrame.unionByName, parts)


def _failed(r: Rule, null_fails: bool) -> Column:
    bad = ~F.expr(r.predicate)
    return F.coalesce(bad, F.lit(null_fails))


def failed_checks(rules: list[Rule], null_fails: bool = False) -> Column:
    """Names of the rules the row actually fails, in rule order, joined by ', ' ('' = passes all).

    ``concat_ws`` skips the NULLs of passing rules, so this stays a plain
    codegen expression (no per-row lambda over an array).
    """
    return F.concat_ws(", ", *[F.when(_failed(r, null_fails), F.lit(r.name)) for r in rules])


def with_failed_checks(df: DataFrame, table: str, registry=QUARANTINE_RULES, null_fails: bool = False) -> DataFrame:
    rules = rules_for(table, registry, "error")
    return df.withColumn("_failed", failed_checks(rules, null_fails))


def quarantine(df: DataFrame, table: str, as_of: _dt.datetime = AS_OF, registry=QUARANTINE_RULES,
               null_fails: bool = False) -> DataFrame:
    """Q-07: rows failing at least one error rule, stamped with time and the comma-joined failed names."""
    x = with_failed_checks(df, table, registry, null_fails)
    return x.where(F.col("_failed") != "").select(
        *df.columns, as_of_ts(as_of).alias("_quarantined_at"), F.col("_failed").alias("_failed_checks"))


def quarantine_split(df: DataFrame, table: str, registry=QUARANTINE_RULES, null_fails: bool = False) -> DataFrame:
    """Q-08: every input row tagged promoted / quarantined (promoted + quarantined = input)."""
    x = with_failed_checks(df, table, registry, null_fails)
    return x.select(*df.columns, F.when(F.col("_failed") != "", F.lit("quarantined")).otherwise(F.lit("promoted"))
                    .alias("_route"))


# -- declarative expectations ---------------------------------------------------


def expectation_metrics(df: DataFrame, table: str, expectations: list[tuple[str, str, str]]) -> DataFrame:
    """Q-02: per expectation, rows evaluated and violations (NULL is not a violation), rows kept as they are."""
    g = df.agg(F.count(F.lit(1)).alias("total_rows"),
               *[_cnt(~F.expr(p)).alias(f"v{i}") for i, (_, p, _) in enumerate(expectations)])
    items = F.array(*[F.struct(F.lit(n).alias("expectation"), F.lit(a).alias("action"),
                               F.col(f"v{i}").alias("failed_records"))
                      for i, (n, _, a) in enumerate(expectations)])
    return g.select(F.lit(table).alias("dataset"), "total_rows", F.explode(items).alias("e")).select(
        "dataset", "e.expectation", "e.action", "total_rows", "e.failed_records")


def expect_or_drop(df: DataFrame, expectations: list[tuple[str, str, str]]) -> DataFrame:
    """Q-03: keep only rows that satisfy every expectation (NULL counts as not satisfied)."""
    cond = reduce(lambda a, b: a & b, [F.coalesce(F.expr(p), F.lit(False)) for _, p, _ in expectations])
    return df.where(cond)


def expect_or_fail(df: DataFrame, expectations: list[tuple[str, str, str]]) -> DataFrame:
    """Q-03: the job fails on the first violating row (checked inside the tasks, no extra pass)."""
    out = df
    for name, p, _ in expectations:
        ok = F.coalesce(F.expr(p), F.lit(True))
        # assert_true returns NULL when the check holds; used in a filter so the optimizer cannot prune it.
        out = out.where(F.assert_true(ok, F.lit(f"expectation failed: {name}")).isNull())
    return out
