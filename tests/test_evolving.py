"""Evolving CSV stream: schemas grow, nothing is lost, a repeated epoch writes nothing twice."""

import os
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import types as T

from pacewise.session import scratch_path
from pacewise.streaming import evolving as ev

TYPES = T.StructType([T.StructField("id", T.LongType()), T.StructField("spend", T.DoubleType()), T.StructField("day", T.DateType())])


class Lab:
    def __init__(self, spark):
        self.spark = spark
        self.landing, self.table, self.ckpt = (scratch_path(spark, f"t-evolving-{n}") for n in ("landing", "table", "ckpt"))
        os.makedirs(self.landing)

    def drop(self, name, text):
        with open(f"{self.landing}/{name}", "w") as f:
            f.write(text)

    def run(self, **options):
        ev.stream_evolving(self.spark, self.landing, self.table, self.ckpt, TYPES, **options)

    def rows(self):
        return sorted((r.asDict() for r in ev.read_evolving(self.spark, self.table).collect()), key=lambda r: (r["id"] is None, r["id"]))


@pytest.fixture
def lab(spark):
    return Lab(spark)


def test_headers_grow_within_and_between_epochs(lab):
    lab.drop("a.csv", "id,spend\n1,1.5\n2,n/a\n")
    lab.drop("b.csv", "spend,id,Note\n2.5,3,hello\n")  # other order and one column more in the same epoch
    lab.run()
    lab.drop("c.csv", "ID,day,spend,extra\n4,1999-01-02,9,x\n5,soon,,\n")
    lab.run()
    version, schema = ev.stored_schema(lab.spark, lab.table)
    assert version == 2 and schema.simpleString() == "struct<id:bigint,spend:double,Note:string,day:date,extra:string>"
    assert [(r["id"], r["spend"], r["Note"], str(r["day"]), r["extra"], r["_rescued"]) for r in lab.rows()] == [
        (1, 1.5, None, "None", None, None), (2, None, None, "None", None, {"spend": "n/a"}), (3, 2.5, "hello", "None", None, None),
        (4, 9.0, None, "1999-01-02", "x", None), (5, None, None, "None", None, {"day": "soon"})]
    assert [(r.version, r.column_name) for r in ev.schema_log(lab.spark, lab.table).orderBy("position").collect()] == [
        (1, "id"), (1, "spend"), (1, "Note"), (2, "day"), (2, "extra")]
    lab.run()  # nothing new
    assert len(lab.rows()) == 5


def test_rescue_keeps_unknown_columns_and_odd_lines(lab):
    lab.drop("a.csv", "id,spend\n1,1.5\n2,2,3\n3\n")
    lab.run(mode="rescue")
    lab.drop("b.csv", "id,new,NEW,spend,Id\n4,a,b,7,44\n")  # a name twice in different cases, the key too
    lab.run(mode="rescue")
    rows = lab.rows()
    assert ev.stored_schema(lab.spark, lab.table)[0] == 1
    assert [(r["id"], r["spend"]) for r in rows] == [(1, 1.5), (2, 2.0), (3, None), (4, 7.0)]
    assert rows[1]["_rescued"] == {ev.LINE: "2,2,3"} and rows[2]["_rescued"] == {ev.LINE: "3"}
    assert {"a", "b", "44"} == set(rows[3]["_rescued"].values())


def test_fail_writes_nothing_until_the_schema_is_grown(lab):
    lab.drop("a.csv", "id\n1\n")
    lab.run(mode="fail")
    lab.drop("b.csv", "id,spend\n2,5\n")
    with pytest.raises(StreamingQueryException):
        lab.run(mode="fail")
    assert [r["id"] for r in lab.rows()] == [1]
    ev.grow_schema(lab.spark, lab.table, [T.StructField("spend", T.DoubleType()), T.StructField("ID", T.StringType())])
    lab.run(mode="fail")
    assert [(r["id"], r["spend"]) for r in lab.rows()] == [(1, None), (2, 5.0)]


def test_empty_files_and_tables(lab):
    lab.drop("a.csv", "")
    lab.run()
    assert ev.read_evolving(lab.spark, lab.table).count() == 0
    lab.drop("b.csv", "id,spend\n")
    lab.drop("c.csv", 'id,spend\n7,"1.0"\n')
    lab.run()
    assert [(r["id"], r["spend"]) for r in ev.read_evolving(lab.spark, lab.table).collect()] == [(7, 1.0)]


def test_a_repeated_epoch_leaves_no_row_twice(lab):
    lab.drop("a.csv", "id\n1\n")
    lab.drop("b.csv", "id,spend\n2,5\n")
    lab.run(files_per_epoch=1)
    before = lab.rows()
    last = max(int(n) for n in os.listdir(f"{lab.ckpt}/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):  # the driver died after the write, before the commit
        if os.path.exists(f"{lab.ckpt}/commits/{name}"):
            shutil.move(f"{lab.ckpt}/commits/{name}", f"{lab.table}-moved-{name}")
    lab.run(files_per_epoch=1)
    assert lab.rows() == before and [r["id"] for r in before] == [1, 2]


def test_schema_versions_are_never_taken_twice(lab):
    from pacewise.sources.files import rename_new, write_text

    ev.grow_schema(lab.spark, lab.table, [T.StructField("id", T.LongType())])
    write_text(lab.spark, f"{lab.table}-schema/_other", "{}")
    assert not rename_new(lab.spark, f"{lab.table}-schema/_other", f"{lab.table}-schema/v000001")
    assert ev.stored_schema(lab.spark, lab.table)[1].simpleString() == "struct<id:bigint>"
