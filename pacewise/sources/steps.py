"""Steps of a job that may die at any point and is then run again.

A job that changes a table reads what it is about to replace. Run again after a
death in the middle, it would read a half-replaced table. So each step writes its
result once into the job's own folder (a Parquet write that is complete has its
``_SUCCESS`` file), and a later run takes it from there: what was read before the
change stays as it was, and the change itself is repeated from the copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from pacewise.sources.files import delete, exists, resolve
from pacewise.sources.sinks import write_partitioned

NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


class Steps:
    """The steps of one job (an epoch of a stream, a batch) in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        #: The column that a step's table is partitioned by, of such as are next written by it.
        self.layout: dict[str, str] = {}

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` gave when the step first came to its end."""
        path = f"{self.folder}/{name}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            build().write.mode("overwrite").partitionBy(*[self.layout[name]] if name in self.layout else []).parquet(path)
        return self.spark.read.parquet(path)

    def done(self) -> bool:
        return exists(self.spark, f"{self.folder}/_DONE")

    def finish(self) -> None:
        """All changes are made: the copies go, the mark stays."""
        fs, p = resolve(self.spark, self.folder)
        for status in fs.listStatus(p) if fs.exists(p) else ():
            if status.getPath().getName() != "_DONE":
                fs.delete(status.getPath(), True)
        fs.create(resolve(self.spark, f"{self.folder}/_DONE")[1]).close()


def replace_partitions(rows: DataFrame, path: str, column: str, values: Iterable) -> None:
    """Make ``rows`` the content of the partitions ``values`` of ``column``; those without rows go.

    ``rows`` must be a written copy. May be repeated until it comes to its end.
    A copy that is partitioned by ``column`` itself is not dealt out again.
    """
    spark = rows.sparkSession
    write_partitioned(rows, path, column, dealt=all(f"/{column}=" in f for f in rows.inputFiles()))
    filled = {r[0] for r in rows.select(column).distinct().collect()}  # partitions of a table
    for value in set(values) - filled:
        delete(spark, f"{path}/{column}={NO_VALUE if value is None else value}")
