"""Spelling variants by finite-state composition.

Two words are near if one inserted, deleted or replaced code point turns one into
the other. The vocabulary is an acceptor; composed with the transducer that makes
exactly one edit and with the acceptor again, it accepts the near pairs.

The composition runs per initial state. A pair whose shorter word has n code
points has its edit behind e common ones, 0 <= e <= n. For e in [low, high) both
words share their first ``low`` and their last n - high code points, so the
words that share these (and whose own length is n or n + 1) are one partition;
what lies between is its acceptor, minimised. Ranges start as halves, and a
partition of more than GROUP words is halved again, down to a single place, where
it has no more words than the alphabet has letters. So are the partitions of long
words, until no more than PLACES code points lie between.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.llm.common import stage, text_session

RUN = re.compile("[a-zA-ZÀ-ÿ]+")
LEAST_LENGTH = 5
LEAST_COUNT = 3
#: A run loses a code point if this divides its checksum.
DAMAGE = 97
#: A word's form has at least so many times its count.
FORM_RATIO = 2
#: Words of one partition, and words that a task takes at a time.
GROUP = 5_000
PLACES = 64
BUCKET_ROWS = 50_000
FLUSH = 500_000


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of ``docs`` (doc_id, text) after damage, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = defaultdict(int)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low = (text or "").encode().lower().decode()  # lower-casing bytes touches A-Z only
                named = crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(RUN.findall(low)).items():
                    h = crc32(word.encode(), named)
                    if h % DAMAGE == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1:]
                    if len(word) >= LEAST_LENGTH:
                        totals[word] += n
            if len(totals) >= FLUSH:
                yield rows(totals)
                totals.clear()
        yield rows(totals)

    def rows(totals: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"])

    found = text_session(docs).select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Acceptor:
    """Minimal acceptors over one set of states: state k has the arcs ``arcs[k]`` and accepts the empty string if ``final[k]``."""

    def __init__(self) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.register: dict[tuple, int] = {}

    def build(self, words: list[str], depth: int = 0) -> int:
        """The state that accepts ``words`` (sorted, distinct) from position ``depth`` on; equal rests are one state."""
        final = bool(words) and len(words[0]) == depth
        arcs = {c: self.build(list(own), depth + 1) for c, own in groupby(words[final:], key=lambda w: w[depth])}
        key = (final, *arcs.items())
        if key not in self.register:
            self.register[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self.register[key]

    def one_edit(self, short: int, long: int, places: int) -> Iterator[tuple[str, str]]:
        """Pairs that the composition accepts: x from ``short`` and a greater x' from it, one replaced, or y from
        ``long`` with one code point more; the edit lies behind fewer than ``places`` common code points."""
        arcs, final = self.arcs, self.final

        @cache
        def both(p: int, q: int) -> list[str]:
            """What states p and q accept both."""
            out = [""] if final[p] and final[q] else []
            other = arcs[q]
            for c, to in arcs[p].items():
                if c in other:
                    out += [c + rest for rest in both(to, other[c])]
            return out

        @cache
        def replaced(p: int, left: int) -> list[tuple[str, str]]:
            out = []
            own = sorted(arcs[p].items())
            for i, (a, to_a) in enumerate(own):
                for b, to_b in own[i + 1:]:
                    out += [(a + rest, b + rest) for rest in both(to_a, to_b)]
                if left > 1:
                    out += [(a + x, a + y) for x, y in replaced(to_a, left - 1)]
            return out

        @cache
        def inserted(p: int, q: int, left: int) -> list[tuple[str, str]]:
            out = []
            for b, to in arcs[q].items():
                out += [(rest, b + rest) for rest in both(p, to) if not rest.startswith(b)]
                if left > 1 and b in arcs[p]:
                    out += [(b + x, b + y) for x, y in inserted(arcs[p][b], to, left - 1)]
            return out

        yield from replaced(short, places)
        yield from inserted(short, long, places)


def near_in_partition(short: dict[str, int], long: dict[str, int], places: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows that are one edit apart: ``short`` and ``long`` give each middle's row."""
    machine = Acceptor()
    first, second = machine.build(sorted(short)), machine.build(sorted(long))
    for x, y in machine.one_edit(first, second, places):
        yield short[x], short[y] if len(x) == len(y) else long[y]


def ranges(rows: DataFrame) -> DataFrame:
    """(word, n, short, low, high): each word in the partitions of its halves, as the shorter and as the longer of a pair."""
    length = F.length("word")

    def half(short: Column) -> list[Column]:
        mid = F.floor((short + 1) / 2).cast("int")
        return [F.struct(short.alias("short"), F.lit(0).alias("low"), mid.alias("high")),
                F.struct(short.alias("short"), mid.alias("low"), (short + 1).alias("high"))]

    parts = F.explode(F.array(*half(length), *half(length - 1))).alias("p")
    return rows.select("word", "n", parts).select("word", "n", "p.*").where(F.col("short") >= LEAST_LENGTH)


def keyed(rows: DataFrame) -> DataFrame:
    """Adds the partition (head, tail) of every row and the middle that its acceptor reads."""
    shared = F.greatest(F.col("short") - F.col("high"), F.lit(0))
    return rows.withColumns({
        "head": F.expr("substring(word, 1, low)"), "tail": F.substring("word", F.length("word") - shared + 1, shared),
        "middle": F.substring("word", F.col("low") + 1, F.length("word") - shared - F.col("low"))})


KEY = ["short", "low", "high", "head", "tail"]


def partitions(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``ranges`` of all words, keyed, every partition halved until it has at most ``group`` words or a single place.

    One of more than PLACES places is halved too, unless it has a single word.
    """
    done, rows = None, stage(keyed(ranges(words)), "spelling-partitions")
    while True:
        places, size = F.col("high") - F.col("low"), F.col("size")
        large = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("size")).where((places > 1) & ((size > group) | ((places > PLACES) & (size > 1))))
        large = stage(large.select(*KEY), "large-partitions")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, KEY, "left_anti").select(rows.columns)
        done = small if done is None else done.unionByName(small)
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(F.array(F.struct("low", mid.alias("high")), F.struct(mid.alias("low"), "high"))).alias("p")
        rows = rows.join(large, KEY, "left_semi").select("word", "n", "short", halves).select("word", "n", "short", "p.*")
        rows = stage(keyed(rows), "spelling-partitions")


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, near, near_n): every ordered pair of near words of ``words`` (word, n; distinct), once."""
    rows = partitions(words, group)
    buckets = 1 + rows.count() // BUCKET_ROWS

    def enumerate_pairs(table: pa.Table) -> pa.Table:
        spelled, counted = table["word"].to_pylist(), table["n"].to_pylist()
        short: dict[tuple, dict[str, int]] = defaultdict(dict)
        long: dict[tuple, dict[str, int]] = defaultdict(dict)
        for row, (*key, middle) in enumerate(zip(*(table[c].to_pylist() for c in (*KEY, "middle")), strict=True)):
            (short if len(spelled[row]) == key[0] else long)[tuple(key)][middle] = row
        left, right = [], []
        for key, own in short.items():
            more = long.get(key, {})
            if len(own) + len(more) > 1:
                for a, b in near_in_partition(own, more, key[2] - key[1]):
                    left += [a, b]
                    right += [b, a]
        return pa.table({"word": pa.array([spelled[i] for i in left], pa.string()), "near": pa.array([spelled[i] for i in right], pa.string()),
                         "near_n": pa.array([counted[i] for i in right], pa.int64())})

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(enumerate_pairs, "word string, near string, near_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), following forms to the last by doubling the steps.

    Each form has at least twice its word's count, so the chains end and are short.
    """
    here = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = here.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = here.join(onward, F.col("root") == F.col("_at"), "left")
        here = stage(moved.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if here.where("moved").isEmpty():
            return here.select("word", "root")


def spelling_variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of Latin letters, A-Z lower-cased, damaged by the checksum
    rule, of at least LEAST_LENGTH code points and LEAST_COUNT occurrences. A
    null text has none; a null doc_id counts as an empty one in the checksum;
    repeated rows count as often as they are there. A word without near words
    has n_near 0, no form, and is its own root. An empty table gives no rows.
    """
    words = stage(word_counts(docs), "vocabulary")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    near = near_pairs(words, group).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    formed = F.col("best.near_n") >= FORM_RATIO * F.col("n")
    judged = stage(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"),
        F.when(formed, F.col("best.near_n")).alias("form_n")), "judged-words")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
