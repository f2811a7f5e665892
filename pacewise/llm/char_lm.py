"""Character n-gram models with modified Kneser-Ney smoothing, one per language, counted by Spark.

A text is its words joined by one space, after ``order - 1`` spaces of padding.
Counts, discounts, back-off weights and interpolated probabilities are
DataFrames over all documents. For scoring, a model that is small enough becomes
sorted arrays of 64-bit n-gram hashes with their log-probabilities, searched by
bisection; a larger one stays a table that document n-grams are joined with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.llm.common import stage, text_session

ORDER = 4
#: N-grams and contexts that tasks may hold as arrays (16 bytes each); a larger model is joined instead.
ARRAY_ENTRIES = 4_000_000
SLICE_BYTES = 1 << 20
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def code_points(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as padded code points one after the other, and each one's number of scored characters."""
    pad, lengths, parts = b" " * (order - 1), [], []
    for t in texts:
        words = b" ".join((t or "").encode().split())  # bytes split at ASCII white space
        units = (pad + words).decode().encode("utf-32-le") if words else b""
        lengths.append(max(0, len(units) // 4 - order + 1))
        parts.append(units)
    return np.frombuffer(b"".join(parts), dtype="<u4"), np.asarray(lengths, dtype=np.int64)


def gram_ends(lengths: np.ndarray, order: int) -> np.ndarray:
    """Positions of all scored characters in what ``code_points`` returns."""
    some = lengths[lengths > 0]
    before = np.cumsum(some) - some + (order - 1) * np.arange(1, len(some) + 1)
    return np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(before, some)


def gram_hash(points: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n code points that end at each of ``ends`` (inclusive)."""
    h = np.full(len(ends), n, dtype=np.uint64)
    for j in range(n - 1, -1, -1):
        h = (h ^ points[ends - j].astype(np.uint64)) * MIX[0]
        h ^= h >> np.uint64(29)
    h = (h ^ (h >> np.uint64(32))) * MIX[1]
    return h ^ (h >> np.uint64(31))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(offset, texts) of some megabytes at a time."""
    block = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield a, texts.slice(a, b - a).to_pylist()


def language(col: str = "lang") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, c): how often each run of ``order`` characters occurs, over all of ``docs`` (text, lang)."""

    def tally(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        points, lengths = code_points(texts, order)
        ends = gram_ends(lengths, order)
        letters = np.flatnonzero(np.bincount(points, minlength=1))
        if len(letters) < 1 << 16:  # four letter numbers fit a 64-bit key
            number = np.zeros(int(points.max(initial=0)) + 1, dtype=np.uint64)
            number[letters] = np.arange(len(letters))
            coded, key = number[points], np.zeros(len(ends), dtype=np.uint64)
            for j in range(order - 1, -1, -1):
                key = (key << np.uint64(16)) | coded[ends - j]
            key.sort()
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=int)
            n, key = np.diff(np.append(new, len(key))), key[new]
            parts = [letters[(key >> np.uint64(16 * j)) & np.uint64(0xFFFF)] for j in range(order - 1, -1, -1)]
            rows = np.stack(parts, axis=1) if len(key) else np.zeros((0, order))
        else:
            rows, n = np.unique(np.stack([points[ends - j] for j in range(order - 1, -1, -1)], axis=1), axis=0, return_counts=True)
        joined = rows.astype("<u4").tobytes().decode("utf-32-le")
        return [joined[k:k + order] for k in range(0, len(joined), order)], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang in batch.column(1).unique().to_pylist():
                own = batch.column(0).filter(pc.equal(batch.column(1), lang))
                for _, texts in text_slices(own):
                    for gram, n in zip(*tally(texts), strict=True):
                        totals[lang, gram] = totals.get((lang, gram), 0) + int(n)
            if len(totals) > 1_000_000:
                yield rows(totals)
                totals = {}
        yield rows(totals)

    def rows(totals: dict[tuple[str, str], int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.string()),
                                           pa.array(list(totals.values()), pa.int64())], names=["lang", "gram", "c"])

    if order > 4:
        raise ValueError("keys hold at most four letters")
    found = text_session(docs).select("text", language().alias("lang")).mapInArrow(run, "lang string, gram string, c bigint")
    return found.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def kneser_ney(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(lang, gram, logp) of the seen n-grams of all orders, and (lang, context, backoff) of their contexts.

    Lower orders count the different characters before an n-gram. Each order
    has three discounts, from how many n-grams were counted one to four times.
    A context whose discounts are zero backs off with the weight of half a count.
    """
    levels = {order: stage(counts, "grams")}
    for n in range(order - 1, 0, -1):
        levels[n] = stage(levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "grams")
    lower, probabilities, backoffs = None, [], []
    for n in range(1, order + 1):
        times = [F.greatest(F.count_if(F.col("c") == k), F.lit(1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        discounts = levels[n].groupBy("lang").agg(*times).select(F.col("lang").alias("_lang"), *[
            F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"), F.lit(0.0)), F.lit(float(k))).alias(f"d{k}") for k in (1, 2, 3)])
        kept = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = (levels[n].join(F.broadcast(discounts), F.col("lang") == F.col("_lang"))  # a row per language
                .select("lang", "gram", "c", F.substring("gram", 1, n - 1).alias("context"), kept.alias("d")))
        contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("backoff"))
        rows = rows.join(contexts, ["lang", "context"])
        if lower is None:
            letters = levels[1].groupBy(F.col("lang").alias("_lang")).agg((1.0 / (F.count(F.lit(1)) + 1)).alias("rest"))
            rows = rows.join(F.broadcast(letters), F.col("lang") == F.col("_lang"))
        else:
            rest = lower.select(F.col("lang").alias("_lang"), F.col("gram").alias("_gram"), F.col("p").alias("rest"))
            rows = rows.join(rest, (F.col("lang") == F.col("_lang")) & (F.substring("gram", 2, n - 1) == F.col("_gram")))
        share = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total") + F.col("backoff") * F.col("rest")
        lower = stage(rows.select("lang", "gram", "context", "backoff", "total", share.alias("p")), "probabilities")
        probabilities.append(lower.select("lang", "gram", F.ln("p").alias("logp")))
        owed = F.when(F.col("backoff") > 0, F.col("backoff")).otherwise(0.5 / (F.col("total") + 1))
        backoffs.append(lower.select("lang", "context", F.ln(owed).alias("backoff")).distinct())
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].union(union(frames[1:]))
    return stage(union(probabilities), "model"), stage(union(backoffs), "backoffs")


@dataclass
class LanguageModel:
    """Sorted hash arrays of one language, by n-gram length."""

    order: int
    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def find(table: tuple[np.ndarray, np.ndarray] | None, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seen, value) of every hash."""
        if table is None or not len(table[0]):
            return np.zeros(len(h), dtype=bool), np.zeros(len(h))
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return table[0][at] == h, table[1][at]

    def log_probability(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the character at each of ``ends``, given those before it; unseen n-grams back off."""
        out, owed, todo = np.zeros(len(ends)), np.zeros(len(ends)), np.arange(len(ends))
        for n in range(self.order, 0, -1):
            seen, value = self.find(self.grams.get(n), gram_hash(points, ends[todo], n))
            out[todo[seen]] = value[seen] + owed[todo[seen]]
            todo = todo[~seen]
            if not len(todo):
                return out
            known, weight = self.find(self.contexts.get(n - 1), gram_hash(points, ends[todo] - 1, n - 1))
            owed[todo] += np.where(known, weight, 0.0)
        letters = len(self.grams[1][0]) if 1 in self.grams else 0
        out[todo] = owed[todo] - math.log(letters + 1)
        return out

    def mean_log(self, texts: list[str | None]) -> np.ndarray:
        """Mean negative log-probability per character (the log of the perplexity); NaN for texts without words."""
        points, lengths = code_points(texts, self.order)
        logs = self.log_probability(points, gram_ends(lengths, self.order))
        sums = np.concatenate([[0.0], np.cumsum(logs)])
        ends = np.cumsum(lengths)
        with np.errstate(invalid="ignore", divide="ignore"):
            return -(sums[ends] - sums[ends - lengths]) / lengths


def hash_arrays(probabilities: DataFrame, backoffs: DataFrame, order: int = ORDER) -> dict[str, LanguageModel] | None:
    """The model as sorted arrays by language, or None if it has more than ARRAY_ENTRIES entries."""
    if probabilities.count() + backoffs.count() > ARRAY_ENTRIES:
        return None

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(1).to_pylist()
            points = np.frombuffer("".join(grams).encode("utf-32-le"), dtype="<u4")
            sizes = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
            ends, h = np.cumsum(sizes) - 1, np.zeros(len(grams), dtype=np.uint64)
            for n in np.unique(sizes):
                h[sizes == n] = gram_hash(points, ends[sizes == n], int(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(h.view(np.int64)), batch.column(2)],
                                             names=["lang", "n", "hash", "value"])

    models: dict[str, LanguageModel] = {}
    for frame, kind in ((probabilities, "grams"), (backoffs, "contexts")):
        rows = frame.mapInArrow(hashed, "lang string, n bigint, hash bigint, value double").toArrow()
        lang, n = (rows[c].to_numpy() for c in ("lang", "n"))
        h, value = rows["hash"].to_numpy().view(np.uint64), rows["value"].to_numpy()
        for code in set(lang):
            model = models.setdefault(code, LanguageModel(order, {}, {}))
            for k in np.unique(n[lang == code]):
                own = (lang == code) & (n == k)
                by_hash = np.argsort(h[own])
                getattr(model, kind)[int(k)] = (h[own][by_hash], value[own][by_hash])
    return models


def gram_scores(grams: DataFrame, probabilities: DataFrame, backoffs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp) of distinct ``grams`` (lang, gram) of ``order`` characters; unseen ones back off, as in LanguageModel."""
    letters = probabilities.where(F.length("gram") == 1).groupBy("lang").agg((-F.ln(F.count(F.lit(1)) + 1.0)).alias("unseen"))
    rows = grams.join(F.broadcast(letters), "lang").withColumns({"rest": F.col("gram"), "owed": F.lit(0.0), "logp": F.lit(None).cast("double")})  # a row per language
    table = probabilities.select("lang", F.col("gram").alias("rest"), F.col("logp").alias("found"))
    weights = backoffs.select("lang", F.col("context").alias("_context"), "backoff")
    for n in range(order, 0, -1):
        rows = rows.join(table.where(F.length("rest") == n), ["lang", "rest"], "left")
        rows = rows.withColumn("logp", F.coalesce("logp", F.col("found") + F.col("owed"))).drop("found")
        rows = rows.withColumn("_context", F.substring("rest", 1, n - 1)).join(weights.where(F.length("_context") == n - 1), ["lang", "_context"], "left")
        rows = stage(rows.select("lang", "gram", "unseen", "logp", F.expr("substring(rest, 2)").alias("rest"),
                                 (F.col("owed") + F.coalesce("backoff", F.lit(0.0))).alias("owed")), "gram-scores")
    return rows.select("lang", "gram", F.coalesce("logp", F.col("owed") + F.col("unseen")).alias("logp"))


def joined_scores(docs: DataFrame, probabilities: DataFrame, backoffs: DataFrame, order: int = ORDER) -> DataFrame:
    """(rid, log_perplexity) of ``docs`` (rid, text, lang) by joining their n-grams with the model's tables.

    For models over ARRAY_ENTRIES.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = b" ".join((text or "").encode().split()).decode()
                padded, seen = " " * (order - 1) + words, {}
                for k in range(len(words)):
                    gram = padded[k:k + order]
                    seen[gram] = seen.get(gram, 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([rid] * len(seen), pa.int64()), pa.array([lang] * len(seen), pa.string()),
                                                  pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                                 names=["rid", "lang", "gram", "times"])

    grams = text_session(docs).select("rid", "text", language().alias("lang")).mapInArrow(run, "rid bigint, lang string, gram string, times bigint")
    grams = stage(grams, "document-grams")
    scores = gram_scores(grams.select("lang", "gram").distinct(), probabilities, backoffs, order)
    return (grams.join(scores, ["lang", "gram"]).groupBy("rid")
            .agg((-F.sum(F.col("times") * F.col("logp")) / F.sum("times")).alias("log_perplexity")))
