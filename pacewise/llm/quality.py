"""Quality rules: text statistics and language-specific perplexity bands.

A document fails on its own statistics (too few words, too much repetition), or
when the log-perplexity of its text under its language's character model
(``char_lm``) lies outside its language's band. A model is counted on documents
that pass the base rules and have few symbols, and never scores a text that it
counted, unless its language has no other. The band is the median of the
language's documents, less WIDTH and plus ABOVE robust standard deviations, from a
histogram over all documents.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pacewise.llm import char_lm
from pacewise.llm.common import look_up, stage, text_session, whole_row
from pacewise.llm.substring_dedup import split_words

MIN_WORDS = 50
REPEAT_SHARE = 50
SYMBOLS = "[#*$%&|<>]"
#: Models are counted on documents with at most one symbol in so many words.
WORDS_A_SYMBOL = 20
WIDTH = 6.0
#: Deviations above the median at which a text is rejected: clean texts of unusual words reach some 25 out of sample
#: (sf0.1), junk begins at 35.
ABOVE = 25.0
#: Histogram step of the log-perplexity, and the least robust deviation.
STEP = 0.0005
LEAST_DEVIATION = 0.01
STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def duplicate_lines(text: str | None) -> int:
    """Lines with a word that equal an earlier line."""
    seen, n = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


def repeated_window_words(code: np.ndarray, doc: np.ndarray, docs: int, width: int = 3) -> np.ndarray:
    """By document: words in windows of ``width`` words that its text has twice or more."""
    if len(code) < width:
        return np.zeros(docs, dtype=np.int64)
    window = doc[:len(code) - width + 1].astype(np.int64)
    for j in range(width):  # number the windows exactly: documents, then one more word at a time
        part = code[j:len(code) - width + 1 + j].astype(np.int64)
        _, window = np.unique(window * (int(code.max()) + 1) + part, return_inverse=True)
    inside = doc[:len(code) - width + 1] == doc[width - 1:]
    again = np.bincount(window[inside], minlength=len(window))[window] > 1
    covered = np.zeros(len(code), dtype=bool)
    for j in range(width):
        covered[j:len(code) - width + 1 + j] |= again & inside
    return np.bincount(doc[covered], minlength=docs)


def statistics(texts: pa.Array) -> list[np.ndarray]:
    """The columns of STATS for some texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    words, count = split_words(texts)
    doc = np.repeat(np.arange(len(count)), count)
    chars = np.bincount(doc, weights=pc.utf8_length(words).to_numpy(zero_copy_only=False), minlength=len(count)).astype(np.int64)
    symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False)
    lines = np.asarray([duplicate_lines(t) for t in texts.to_pylist()], dtype=np.int64)
    code = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return [count, chars, symbols, lines, repeated_window_words(code, doc, len(count))]


def scorer(models: dict[str, char_lm.LanguageModel] | None) -> Callable[[Column, Column], Column]:
    """Statistics and log-perplexity (null without a model or words) of (text, fold and lang), as one struct column."""

    def score(texts: pa.Array, langs: pa.Array) -> pa.Array:
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        perplexity = np.full(len(texts), np.nan)
        for at, part in char_lm.text_slices(texts):
            for column, values in zip(columns, statistics(texts.slice(at, len(part))), strict=True):
                column.append(values)
            lang = np.asarray(langs.slice(at, len(part)).to_pylist(), dtype=object)
            for code in set(lang) if models else ():
                own = np.flatnonzero(lang == code)
                model = models.get(other_half(code)) or models.get(code)
                if model:
                    perplexity[at + own] = model.mean_log([part[i] for i in own])
        arrays = [pa.array(np.concatenate(c) if c else [], pa.int64()) for c in columns]
        names = [x.split()[0] for x in STATS.split(", ")]
        return pa.StructArray.from_arrays([*arrays, pa.array(perplexity, from_pandas=True)], names=[*names, "log_perplexity"])

    # As a deterministic function it would be evaluated again in every filter that the optimiser moves below a join.
    return F.arrow_udf(score, f"struct<{STATS.replace(' bigint', ':bigint')}, log_perplexity:double>").asNondeterministic()


def base_failed(s: str = "s") -> Column:
    n = F.col(f"{s}.n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{s}.n_repeat_words") > REPEAT_SHARE * n)


def bands(scored: DataFrame, width: float = WIDTH, above: float | None = None) -> DataFrame:
    """(lang, low, high) from the log-perplexities of the documents that pass the base rules.

    ``above`` is the width above the median, if it differs.
    The median and the median absolute deviation are read from a histogram of
    STEP-wide bins, which partial aggregation adds up; the windows see one row
    per language and bin.
    """

    def middle(rows: DataFrame, value: str) -> DataFrame:
        upto = Window.partitionBy("lang").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        everything = Window.partitionBy("lang")
        return (rows.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(everything))
                .where(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min(value).alias(value)))

    bins = (scored.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull())
            .groupBy("lang", F.round(F.col("log_perplexity") / STEP).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    bins = stage(bins, "perplexity-bins")
    centre = middle(bins, "bin").withColumnRenamed("bin", "centre")
    off = bins.join(centre, "lang").groupBy("lang", F.abs(F.col("bin") - F.col("centre")).alias("off")).agg(F.sum("n").alias("n"))
    spread = F.greatest(F.col("off") * F.lit(1.4826 * STEP), F.lit(LEAST_DEVIATION))
    return centre.join(middle(off, "off"), "lang").select(
        "lang", (F.col("centre") * STEP - spread * width).alias("low"),
        (F.col("centre") * STEP + spread * (width if above is None else above)).alias("high"))


def half(text: str = "text", lang: str = "lang") -> Column:
    """The half of its language that a text is counted in ('0' or '1', by its hash), and the language."""
    return F.concat(F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(2)).cast("string"), char_lm.language(lang))


def other_half(code: str) -> str:
    return ("1" if code[0] == "0" else "0") + code[1:]


def reference_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) by half of a language, over its documents that pass the base rules and have few symbols.

    Where more than half of a language's passing documents have more symbols,
    they are its kind of text, and all that pass are counted.
    """
    rows = text_session(docs).select("text", half().alias("half"), scorer(None)(F.col("text"), F.lit("")).alias("s")).where(~base_failed())
    few = F.when(WORDS_A_SYMBOL * F.col("s.n_symbols") <= F.col("s.n_words"), "+").otherwise("-")
    counts = stage(char_lm.count_grams(rows.select("text", F.concat(few, "half").alias("lang"))), "reference-grams")
    counts = counts.select(F.col("lang").startswith("+").alias("few"), F.expr("substring(lang, 2)").alias("lang"), "gram", "c")
    # Every text has one n-gram that begins with all of the padding.
    texts = counts.where(F.col("gram").startswith(" " * (char_lm.ORDER - 1)))
    texts = texts.groupBy(F.expr("substring(lang, 2)").alias("name")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("few"), F.col("c"))).alias("n_few"))
    symbolic = texts.select("name", (2 * F.coalesce("n_few", F.lit(0)) < F.col("n")).alias("symbolic"))
    used = look_up(counts.withColumn("name", F.expr("substring(lang, 2)")), symbolic, "name").where(F.col("few") | F.col("symbolic"))
    return used.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def language_models(docs: DataFrame) -> tuple[dict[str, char_lm.LanguageModel] | None, DataFrame, DataFrame]:
    """Models of the halves of all languages in ``docs`` as arrays (None if too large for tasks), and as two tables."""
    probabilities, backoffs = char_lm.kneser_ney(reference_grams(docs))
    return char_lm.hash_arrays(probabilities, backoffs), probabilities, backoffs


def score_rows(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """``rows`` (half and further columns) without half, with the statistics, base_failed and log_perplexity of ``text``; a written copy.

    The models are those of ``docs``. If they are too large for tasks, the rows
    are numbered in a written copy and joined with the model's tables.
    """
    models, probabilities, backoffs = language_models(docs)
    carried = [c for c in rows.columns if c != "half"]
    if models is None:
        rows = stage(rows.withColumn("rid", F.monotonically_increasing_id()), "numbered-rows")
        carried = [*carried, "rid"]
    scored = rows.select(*carried, scorer(models)(text, F.col("half")).alias("s"))
    carried = [c for c in carried if c != "text"]
    scored = scored.select(*carried, "s.*", base_failed().alias("base_failed"))
    if models is None:
        other = F.concat(F.when(F.col("half").startswith("0"), "1").otherwise("0"), F.expr("substring(half, 2)"))
        there = probabilities.select(F.col("lang").alias("other")).distinct().withColumn("there", F.lit(True))
        read = look_up(rows.select("rid", text.alias("text"), "half", other.alias("other")), there, "other")
        read = read.select("rid", "text", F.when(F.col("there"), F.col("other")).otherwise(F.col("half")).alias("lang"))
        scored = scored.drop("log_perplexity").join(stage(char_lm.joined_scores(read, probabilities, backoffs), "joined-scores"), "rid", "left").drop("rid")
    return stage(scored, "scored")


def in_band(perplexity: Column) -> Column:
    return F.coalesce(perplexity.between(F.col("low"), F.col("high")), F.lit(False))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the statistics, base_failed, log_perplexity, low, high, kept for every row of ``docs``.

    ``docs`` has doc_id, text, lang; other columns are ignored. A null text has
    no words and fails the base rules, like an empty one; a null lang is the
    language ''. Repeated rows are judged alike. An empty table gives no rows.
    """
    scored = score_rows(docs.select("doc_id", char_lm.language().alias("lang"), "text", half().alias("half")), docs, F.col("text"))
    judged = look_up(scored, bands(scored, above=ABOVE), "lang")
    return judged.withColumn("kept", ~F.col("base_failed") & in_band(F.col("log_perplexity")))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns and no others; they are scored once, in the copy that is filtered."""
    rows = docs.select(whole_row(docs), char_lm.language().alias("lang"), half().alias("half"))
    scored = score_rows(rows, docs, F.col("_row.text"))
    judged = look_up(scored.select("_row", "lang", "base_failed", "log_perplexity"), bands(scored, above=ABOVE), "lang")
    return judged.where(~F.col("base_failed") & in_band(F.col("log_perplexity"))).select("_row.*")
