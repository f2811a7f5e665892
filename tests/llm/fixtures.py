"""Small documents with every awkward case, and plain-Python helpers for brute-force versions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
#: Column names that the operators use inside.
CLASHING = ["rid", "size", "shard", "slot", "digest", "fp", "rate", "s", "kept", "low", "_row", "_key", "chars", "tokens", "toxic", "gram"]

LONG = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
PLAIN = "The quick brown fox jumps over the lazy dog and runs far away from all the noise of the old town tonight"
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\r\x0b\x0c ", None, None, 7), (4, PLAIN, "en", "b", 1),
    (5, PLAIN, "en", "b", 1), (6, PLAIN + " again", "de", None, 1), (7, LONG, "en", "c", 1), (8, "één ñandú ß 日本語 🙂", "fr", "c", 1),
    (9, "x", "en", "d", 1), (9, "x", "en", "d", 1), (None, "no id here", "en", "a", 1), (None, None, None, None, None),
    (10, "a\xa0b\x85c\x1cd <|endoftext|> \\ <| \x00", "en", "a", 1), (11, "same\nsame\n\nsame\n", "en", "a", 1),
]


def docs(spark, rows=None, clashing: bool = False):
    frame = spark.createDataFrame(AWKWARD if rows is None else rows, SCHEMA)
    return frame.select("*", *[F.lit("mine").alias(c) for c in CLASHING]) if clashing else frame


def written(spark, frame, tmp_path):
    path = str(tmp_path / "docs")
    frame.write.parquet(path)
    return spark.read.parquet(path)


def words(text):
    return WORDS.findall(text or "")


def given(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")
