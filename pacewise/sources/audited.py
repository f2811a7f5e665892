"""Writes that are measured as they run and audited before anybody sees them.

A load is written into a staged folder beside the table. Its expectations are
counted by the write's own tasks (``DataFrame.observe``), so there is no second
scan. Rows that break a ``drop`` rule are left out; if a ``fail`` rule was
broken by any row, the staged folder goes and the table stays as it was; else
one rename makes the load visible. What was counted is kept as a table either way.

The counts are exact when tasks are run again: ``observe`` stands right below
the write, in the job's last stage, and Spark takes the figures of one
completed task per partition there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pacewise.sources.files import delete, exists, rename_new
from pacewise.sources.sinks import read_if_present

#: (name, predicate, action): ``keep`` only counts, ``drop`` leaves the row out, ``fail`` refuses the load.
Expectation = tuple[str, str, str]
REPORT = ("load string, expectation string, action string, total_rows bigint, failed_records bigint, "
          "written_rows bigint, passed boolean")


def _violated(predicate: str, action: str) -> Column:
    """Whether a row breaks a rule. A NULL predicate breaks a ``drop`` rule only (as in ``operators.quality``)."""
    return ~F.coalesce(F.expr(predicate), F.lit(action != "drop"))


def measured(df: DataFrame, expectations: list[Expectation], name: str = "audit") -> tuple[DataFrame, Observation]:
    """``df`` without the rows that ``drop`` rules refuse, and the counts that its next action takes on the way.

    The observation holds ``total_rows``, ``written_rows`` and ``failed_<i>`` for each expectation.
    """
    drops = [_violated(p, a) for _, p, a in expectations if a == "drop"]
    stays = ~reduce(lambda a, b: a | b, drops) if drops else F.lit(True)
    seen = Observation(name)
    counts = [F.count_if(_violated(p, a)).alias(f"failed_{i}") for i, (_, p, a) in enumerate(expectations)]
    counted = df.observe(seen, F.count(F.lit(1)).alias("total_rows"), F.count_if(stays).alias("written_rows"), *counts)
    return (counted.where(stays) if drops else counted), seen


@dataclass(frozen=True)
class AuditedTable:
    """A Parquet table at ``path`` that grows by audited loads, one folder ``_load=<name>`` each; a report table lies beside it."""

    spark: SparkSession
    path: str

    def _folder(self, load: str) -> str:
        return f"{self.path.rstrip('/')}/_load={load}"

    @property
    def _reports(self) -> str:
        return f"{self.path.rstrip('/')}-audit"

    def append(self, df: DataFrame, load: str, expectations: list[Expectation]) -> bool:
        """Write ``df`` as the load ``load`` (letters, digits, ``-``), visible only if no ``fail`` rule was broken. Whether it is.

        A load that is visible is not written again, so a job that died may simply be repeated. The report is written
        before the rename: a load that died between the two has a report and no rows, and is written anew.
        """
        if not load.replace("-", "").isalnum():
            raise ValueError(f"load name {load!r}")
        if exists(self.spark, self._folder(load)):
            return True
        staged = f"{self.path.rstrip('/')}-staged/{load}"
        rows, seen = measured(df, expectations)
        rows.write.mode("overwrite").parquet(staged)
        counts = seen.get
        if not counts:  # no task ran, so nothing was counted: the input has no rows
            counts = {"total_rows": 0, "written_rows": 0}
        failed = [int(counts.get(f"failed_{i}") or 0) for i in range(len(expectations))]
        passed = not any(n for n, (_, _, a) in zip(failed, expectations, strict=True) if a == "fail")
        written = int(counts["written_rows"] or 0) if passed else 0
        report = [(load, name, action, int(counts["total_rows"] or 0), n, written, passed)
                  for n, (name, _, action) in zip(failed, expectations, strict=True)]
        self.spark.createDataFrame(report, REPORT).coalesce(1).write.mode("overwrite").parquet(f"{self._reports}/_of={load}")
        if not passed:
            delete(self.spark, staged)
            return False
        rename_new(self.spark, staged, self._folder(load))
        return True

    def rows(self) -> DataFrame:
        """The rows of all visible loads."""
        return self.spark.read.parquet(self.path).drop("_load")

    def report(self) -> DataFrame:
        """A row per load and expectation, of refused loads too."""
        return read_if_present(self.spark, self._reports, REPORT + ", _of string").drop("_of")
