"""The corpus pipeline: quality rules, exact dedup, near-dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns rows with the columns of ``docs``; the last returns pieces in
sequences. ``run`` writes each stage's rows as Parquet into the shared folder
and reads them again, so a lost executor never costs more than its stage. What a
stage wrote on its way goes when the next one begins, as its rows are then written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pacewise.llm import exact_dedup, mixing, packing, quality, simhash_dedup
from pacewise.llm.common import stage, table
from pacewise.llm.queries import tokenizer_file
from pacewise.session import drop_scratch, scratch_given, scratch_path, scratch_since

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: The folders that a stage's last call wrote on its way, by the stage's function name.
_LEFT: dict[str, list[str]] = {}


def after(before: str | None) -> Callable[[Stage], Stage]:
    """A stage that drops what the stage ``before`` it wrote on its way: that stage's rows have been written and read again."""

    def of(fn: Stage) -> Stage:
        @wraps(fn)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            drop_scratch(spark, _LEFT.pop(before, []))
            mark = scratch_given()
            out = fn(spark, docs, sf_dir)
            _LEFT[fn.__name__] = scratch_since(mark)
            return out

        return run_stage

    return of


@after(None)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band."""
    return quality.keep_good(docs)


@after("quality_rules")
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest doc_id."""
    return exact_dedup.keep_one(docs, exact_dedup.DigestIndex(spark, scratch_path(spark, "digest-index")), "pipeline")


@after("exact_duplicates")
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-equal texts: the one with the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


@after("near_duplicates")
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's rate and its draw say; copies are equal rows."""
    return mixing.mix(docs)


@after("source_mixing")
def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", sequence_packing),
]

# Perplexities, SimHash components and BPE ids have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = table(spark, sf_dir, "documents"), []
    for name, fn in STAGES[:-1]:
        rows = fn(spark, docs, sf_dir)
        mark = scratch_given()
        docs = stage(rows, name.replace(" ", "-"))
        written = scratch_since(mark)
        drop_scratch(spark, read)  # the rows that this stage read
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)
