"""Small calls to the file system that a path lies in, through Hadoop, so that they reach whatever store it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def resolve(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = resolve(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = resolve(spark, path)
    fs.delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in the folder ``path``; none where there is no such folder."""
    fs, p = resolve(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = resolve(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Give ``source`` the name ``target`` unless that is taken; whether it got it.

    One step of the file system where it renames atomically (HDFS, local); an
    object store without atomic renames needs a committer that has them.
    """
    fs, s = resolve(spark, source)
    _, t = resolve(spark, target)
    if fs.exists(t):
        return False
    fs.mkdirs(t.getParent())
    return bool(fs.rename(s, t))
