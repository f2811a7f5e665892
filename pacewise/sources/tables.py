"""Scans of the given Parquet tables.

Only the named columns are selected so the scan's ReadSchema is pruned at the
source; filters applied later are pushed into the Parquet reader by Catalyst.

Scan parallelism: Spark splits Parquet input by row group. A table stored as
one file with one row group is read by ONE task, and everything before the
first shuffle (join probe, projections, the partial dedup limit) runs in that
task. On a cluster the inputs are many multi-row-group files and no action is
needed. For small single-row-group inputs (the local test tables) set
``pacewise.scan.partitions`` to spread rows by a hash of the leading key column right after the scan;
unset (the default) adds nothing to the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Declared schemas of the given tables. A declared schema means the reader runs no
# footer-inference job when a DataFrame is built (at cluster scale: no driver-side
# footer reads across thousands of files). Tables not listed are inferred.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
}

# TPC-H fixed-size dimensions (25 and 5 rows at every scale): never repartitioned, safe to broadcast.
FIXED_SIZE = {"region", "nation"}
SCAN_PARTITIONS_CONF = "pacewise.scan.partitions"


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(table_path(sf_dir, name))


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = read_table(spark, sf_dir, name)
    if columns:
        df = df.select(*columns)
    parts = int(spark.conf.get(SCAN_PARTITIONS_CONF, "0") or 0)
    if parts > 0 and name not in FIXED_SIZE:
        # Hash on the leading (key) column: deterministic on task retry without the local sort a
        # round-robin split needs for that guarantee.
        df = df.repartition(parts, df.columns[0])
    return df
