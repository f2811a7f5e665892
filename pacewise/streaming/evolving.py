"""A stream of CSV files whose headers change.

The stream carries files, not columns: each epoch takes the paths that landed,
groups them by header, reads each group under its own header and binds it by
name to the table's stored schema. Nothing is lost:

* a header the schema does not know is added to it (``add``), kept as text in
  the rescued map (``rescue``), or stops the stream before anything of the epoch
  is written (``fail``); the stopped stream goes on from the same files once the
  schema has been grown by ``grow_schema`` or the mode changed;
* a value that is not of its column's type is NULL there and kept as text in the
  rescued map, under its column's name;
* a line that has more or fewer values than its header is kept whole in the
  rescued map, under ``LINE``, beside the values that could be bound.

Each schema is a file of its own that is never changed, so an epoch that is
repeated finds the schema it had or a later one, and columns keep their types.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacewise.sources.csv import CSV_OPTIONS
from pacewise.sources.files import delete, exists, list_names, rename_new, write_text

RESCUED = "_rescued"
#: Key of a whole line in the rescued map; no header can be equal to it, as headers are trimmed of white space.
LINE = " line"
#: Files of one epoch at most: the driver reads a line of each.
FILES_PER_EPOCH = 1_000
HEADER_READERS = 16
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                      T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


class UnknownColumns(ValueError):
    """Headers that the table's schema lacks, in mode ``fail``."""


def _schemas(table: str) -> str:
    return f"{table.rstrip('/')}-schema"


def stored_schema(spark: SparkSession, table: str) -> tuple[int, T.StructType]:
    """The number and the fields of the table's newest schema; (0, no fields) where there is none."""
    versions = sorted(n for n in list_names(spark, _schemas(table)) if n.startswith("v"))
    if not versions:
        return 0, T.StructType([])
    text = spark.read.text(f"{_schemas(table)}/{versions[-1]}", wholetext=True).first()[0]
    return int(versions[-1][1:]), T.StructType.fromJson(json.loads(text))


def grow_schema(spark: SparkSession, table: str, fields: Sequence[T.StructField]) -> T.StructType:
    """Add those of ``fields`` whose names (in any case) the table lacks, as the next schema; returns the newest one.

    A schema file comes into being by one rename that fails if the name is taken: of two that grow the
    schema at once, the second starts again from what the first wrote.
    """
    while True:
        version, schema = stored_schema(spark, table)
        known = {f.name.lower() for f in schema.fields}
        new: dict[str, T.StructField] = {}
        for f in fields:
            if f.name.lower() not in known:
                new.setdefault(f.name.lower(), f)
        if not new:
            return schema
        grown = T.StructType([*schema.fields, *new.values()])
        draft = f"{_schemas(table)}/_draft-{version + 1:06d}"
        write_text(spark, draft, json.dumps(grown.jsonValue()))
        if rename_new(spark, draft, f"{_schemas(table)}/v{version + 1:06d}"):
            return grown
        delete(spark, draft)


def schema_log(spark: SparkSession, table: str) -> DataFrame:
    """(version, position, column_name, type): every column with the schema that brought it."""
    rows, seen = [], 0
    for name in sorted(n for n in list_names(spark, _schemas(table)) if n.startswith("v")):
        text = spark.read.text(f"{_schemas(table)}/{name}", wholetext=True).first()[0]
        fields = T.StructType.fromJson(json.loads(text)).fields
        rows += [(int(name[1:]), i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields) if i >= seen]
        seen = len(fields)
    return spark.createDataFrame(rows, "version int, position int, column_name string, type string")


def file_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The first line of a CSV file, as its names stand there (a reader with ``header`` renames names that come twice)."""
    first = spark.read.options(**{**CSV_OPTIONS, "header": "false"}).csv(path).first()
    return tuple(n if n and n.strip() else f"_c{i}" for i, n in enumerate(first or ()))


def bind(spark: SparkSession, paths: list[str], header: list[str], schema: T.StructType) -> DataFrame:
    """The files ``paths``, all of this ``header``, as the columns of ``schema`` and RESCUED (NULL where nothing was rescued)."""
    texts = [f"c{i}" for i in range(len(header))]
    raw = (spark.read.options(**CSV_OPTIONS).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line")
           .schema(T.StructType([T.StructField(c, T.StringType()) for c in [*texts, "line"]])).csv(paths))
    first: dict[str, str] = {}
    for text, name in zip(texts, header, strict=True):
        first.setdefault(name.strip().lower(), text)

    def entry(name: str, text: str) -> Column:
        return F.struct(F.lit(name).alias("k"), F.col(text).alias("v"))

    columns, bound = [], set()
    rescued = [F.when(F.col("line").isNotNull(), entry(LINE, "line"))]
    for f in schema.fields:
        text = first.get(f.name.lower())
        if text is None:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        bound.add(text)
        value = F.col(text).try_cast(f.dataType)
        columns.append(value.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            rescued.append(F.when(F.col(text).isNotNull() & value.isNull(), entry(f.name, text)))
    taken = {f.name for f in schema.fields} | {n.strip() for n in header}
    # Headers that the schema lacks; one that differs from an earlier one only in its case gets a number that makes it a name of its own.
    for text, name in zip(texts, header, strict=True):
        if text not in bound:
            key = name.strip()
            if first[key.lower()] != text:
                key = next(f"{key} {i}" for i in range(2, len(header) + 2 + len(taken)) if f"{key} {i}" not in taken)
                taken.add(key)
            rescued.append(F.when(F.col(text).isNotNull(), entry(key, text)))
    kept = F.array_compact(F.array(*rescued))
    return raw.select(*columns, F.when(F.size(kept) > 0, F.map_from_entries(kept)).alias(RESCUED))


def stream_evolving(spark: SparkSession, landing: str, table: str, checkpoint: str, types: T.StructType,
                    mode: str = "add", files_per_epoch: int = FILES_PER_EPOCH) -> None:
    """Append every CSV file under ``landing`` that no earlier run has taken to the Parquet table at ``table``; stop when caught up.

    ``types`` gives the types of columns by name; the table starts with the first header's columns, and a column of no
    given type is text. Every epoch writes a folder of its own in overwrite mode, so a replayed epoch leaves no row twice.
    """
    if mode not in ("add", "rescue", "fail"):
        raise ValueError(f"mode {mode!r}: add, rescue or fail")
    typed = {f.name.lower(): f for f in types.fields}

    def headers(paths: list[str]) -> dict[tuple[str, ...], list[str]]:
        with ThreadPool(HEADER_READERS) as pool:
            found = pool.map(lambda p: file_header(spark, p), paths)
        groups = defaultdict(list)
        for path, header in zip(paths, found, strict=True):
            if header:  # an empty file has none, and no rows
                groups[header].append(path)
        return groups

    def process(batch: DataFrame, epoch: int) -> None:
        paths = sorted(r["path"] for r in batch.select("path").collect())  # at most files_per_epoch
        groups = headers(paths)
        names = list(dict.fromkeys(n.strip() for header in groups for n in header))
        fields = [typed.get(n.lower(), T.StructField(n, T.StringType())) for n in names]
        version, schema = stored_schema(spark, table)
        unknown = {f.name.lower() for f in fields} - {f.name.lower() for f in schema.fields}
        if version == 0 or (unknown and mode == "add"):
            schema = grow_schema(spark, table, fields)
        elif unknown and mode == "fail":
            raise UnknownColumns(", ".join(sorted(unknown)))
        if groups:
            parts = [bind(spark, group, list(header), schema) for header, group in groups.items()]
            reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(f"{table.rstrip('/')}/_epoch={epoch}")

    q = (spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv*").option("recursiveFileLookup", "true")
         .option("maxFilesPerTrigger", str(files_per_epoch)).load(landing).select("path")
         .writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_evolving(spark: SparkSession, table: str) -> DataFrame:
    """The rows of all epochs under the newest schema: columns that came later are NULL in earlier rows."""
    _, schema = stored_schema(spark, table)
    rescued = T.StructField(RESCUED, T.MapType(T.StringType(), T.StringType()))
    whole = T.StructType([*schema.fields, rescued])
    if not exists(spark, table):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(table).drop("_epoch")
