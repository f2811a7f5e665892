"""CSV readers.

``read_csv_by_name`` binds columns by HEADER NAME, not position: every column
is read as text, then selected by name and converted with ``try_cast``. A
file with an extra column (e.g. ``segment`` inserted after ``brand_code``)
therefore cannot shift later columns, which is what a positional user schema
silently does. Missing and unexpected headers are reported, not guessed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "timestampFormat": "yyyy-MM-dd HH:mm:ss",
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss",
    "dateFormat": "yyyy-MM-dd",
}


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header names of the CSV files at ``path`` (planning reads only the first line)."""
    return spark.read.options(**CSV_OPTIONS).option("inferSchema", "false").csv(path).columns


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the CSV files at ``path`` as text, under their header's names.

    ``enforceSchema=false`` checks every file's header against the first one's:
    a folder that mixes headers raises instead of shifting values.
    """
    header = csv_header(spark, path)
    text_schema = T.StructType([T.StructField(h, T.StringType(), True) for h in header])
    return spark.read.options(**CSV_OPTIONS).option("enforceSchema", "false").schema(text_schema).csv(path)


def read_csv_by_name(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Typed frame with exactly the schema's columns, bound by header name.

    Headers absent from the file become NULL columns of the declared type;
    headers not in the schema are dropped (``csv_header_report`` tells which).
    Files with different headers are given as a list of paths, each file or
    folder with one header; a folder that mixes headers raises.
    """
    if not isinstance(path, str):
        return reduce(DataFrame.unionByName, [read_csv_by_name(spark, p, schema) for p in path])
    raw = _texts(spark, path)
    cols = []
    for f in schema.fields:
        if f.name in raw.columns:
            c = F.col(f"`{f.name}`")
            cols.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def csv_header_report(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """(column_name, in_schema, in_file, failed_casts): how the files' headers and values fit the schema.

    failed_casts counts values that are present but not of the declared type,
    over all files that have the column; NULL where a column is on one side only.
    """
    types = {f.name: f.dataType for f in schema.fields}
    parts = []
    for p in [path] if isinstance(path, str) else path:
        raw = _texts(spark, p)
        failed = [F.count_if(F.col(f"`{h}`").isNotNull() & F.col(f"`{h}`").try_cast(types[h]).isNull()) if h in types else F.lit(None).cast("long")
                  for h in raw.columns]
        row = raw.agg(*[c.alias(f"c{i}") for i, c in enumerate(failed)])
        items = [F.struct(F.lit(h).alias("column_name"), F.lit(True).alias("seen"), F.col(f"c{i}").alias("failed")) for i, h in enumerate(raw.columns)]
        items += [F.struct(F.lit(n).alias("column_name"), F.lit(False).alias("seen"), F.lit(None).cast("long").alias("failed")) for n in types]
        parts.append(row.select(F.explode(F.array(*items)).alias("x")).select("x.*"))
    found = reduce(DataFrame.unionByName, parts).groupBy("column_name").agg(F.max("seen").alias("in_file"), F.sum("failed").alias("failed_casts"))
    return found.select("column_name", F.col("column_name").isin(*types).alias("in_schema"), "in_file", "failed_casts")


def read_csv_inferred(spark: SparkSession, path: str, sampling_ratio: float = 1.0) -> DataFrame:
    """Schema inferred from the data (an extra pass over the sample; prefer explicit schemas at scale)."""
    return (spark.read.options(**CSV_OPTIONS).option("inferSchema", "true")
            .option("samplingRatio", str(sampling_ratio)).csv(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)
