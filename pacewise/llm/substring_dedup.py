"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of a document; its minimiser is the
smallest hash among the ``SEED``-word runs inside it. Consecutive windows that
share a minimiser travel as one packed string (a super-k-mer) to the minimiser's
bucket, so all occurrences of a window meet there, and a bucket sorts its
windows to find those that also start in a document with a smaller id. Words
that such windows cover are removed.

Packed strings go as compressed Arrow blocks, one per slice of documents and
bucket. A minimiser of very many super-k-mers (a passage that countless
documents share) would be too much for a bucket; its windows go one by one
through a native aggregation instead, where partial aggregation and AQE's skew
join keep any number of copies apart. Which way a window goes does not change
the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.llm.common import stage, text_session

WINDOW = 13
SEED = 3
SLICE_BYTES = 2 << 20
#: Super-k-mers that a bucket holds on average.
BUCKET_ROWS = 80_000
#: A minimiser leaves its bucket beyond this many super-k-mers, or beyond this share of all: the list of such
#: minimisers that tasks get never exceeds HEAVY_LIST entries of 8 bytes.
HEAVY_ROWS = 20_000
HEAVY_LIST = 65_536

MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
RANGES = "doc_id bigint, variant bigint, start bigint, stop bigint"


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    reach, out = 1, x
    while reach < width:
        step = min(reach, width - reach)
        out = np.minimum(out[:-step], out[step:])
        reach += step
    return out


@dataclass
class Slice:
    """Some documents as one run of words, with the super-k-mers found in it."""

    words: pa.Array
    doc: np.ndarray  # by word: index of its document
    at: np.ndarray  # by word: its position in the document
    begin: np.ndarray  # by super-k-mer: its first word
    end: np.ndarray  # and the one after its last
    mini: np.ndarray

    def packed(self) -> tuple[memoryview, np.ndarray]:
        """The bytes of all words, each with a space behind it, and where each begins."""
        empty = pa.scalar("", self.words.type)
        spaced = pc.binary_join_element_wise(self.words, empty, pa.scalar(" ", self.words.type))
        offsets = np.frombuffer(spaced.buffers()[1], dtype=np.int64)[spaced.offset:spaced.offset + len(spaced) + 1]
        return memoryview(spaced.buffers()[2] or b""), offsets


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in order, and the number of each text's."""
    pieces = pc.ascii_split_whitespace(texts)
    flat = pieces.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = pieces.offsets.to_numpy() - pieces.offsets.to_numpy()[0]
    return flat.filter(pa.array(real)), np.diff(np.concatenate([[0], np.cumsum(real)])[bounds])


def super_kmers(texts: pa.Array, window: int = WINDOW, seed: int = SEED) -> Slice:
    from xxhash import xxh64_intdigest

    words, count = split_words(texts)
    coded = words.dictionary_encode()
    known = np.fromiter((xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    h = known[coded.indices.to_numpy(zero_copy_only=False)]
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
    none = np.zeros(0, dtype=np.int64)
    if len(h) < window:
        return Slice(words, doc, at, none, none, none.astype(np.uint64))
    run = h[:len(h) - seed + 1]
    for j in range(1, seed):
        run = run * MIX[0] + h[j:len(h) - seed + 1 + j]
    mini = sliding_min(mix64(run), window - seed + 1)
    first = np.flatnonzero(doc[:len(h) - window + 1] == doc[window - 1:])  # windows inside one document
    if not len(first):
        return Slice(words, doc, at, none, none, none.astype(np.uint64))
    mini = mini[first]
    new = np.concatenate([[True], (np.diff(first) != 1) | (mini[1:] != mini[:-1])])
    last = np.concatenate([new[1:], [True]])
    return Slice(words, doc, at, first[new], first[last] + window, mini[new])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Slice]]:
    """(doc_ids, variants, slice) of (doc_id, text, variant) batches, some megabytes of text at a time."""
    for batch in batches:
        texts = batch.column(1).cast(pa.large_string())
        ids, variants = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield ids[a:b], variants[a:b], super_kmers(texts.slice(a, b - a))


def minimiser_load(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of super-k-mers, and the minimisers that are too many for a bucket.

    A slice reports the minimisers that it holds more than once; a heavy one is
    many times in most slices.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for _, _, s in slices(batches):
            total += len(s.mini)
            mini, n = np.unique(s.mini, return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(mini[often].view(np.int64)), pa.array(n[often]),
                                              pa.array(np.zeros(often.sum(), dtype=bool))], names=["mini", "n", "all"])
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([total]), pa.array([True])], names=["mini", "n", "all"])

    loads = stage(docs.mapInArrow(count, "mini bigint, n bigint, all boolean").groupBy("all", "mini").agg(F.sum("n").alias("n")), "minimisers")
    total = loads.where("all").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(HEAVY_ROWS, total // HEAVY_LIST)
    heavy = [r[0] for r in loads.where(~F.col("all") & (F.col("n") > most)).select("mini").collect()]  # at most HEAVY_LIST
    return total, np.sort(np.asarray(heavy, dtype=np.int64).view(np.uint64))


def pack_block(doc: np.ndarray, variant: np.ndarray, start: np.ndarray, strings: list[memoryview]) -> tuple[int, bytes]:
    """Some super-k-mers as (size, compressed bytes): doc_ids, variants (mostly zeros), first words, string sizes, strings."""
    sizes = np.fromiter(map(len, strings), dtype="<i4", count=len(strings))
    raw = b"".join((doc.astype("<i8").tobytes(), variant.astype("<i8").tobytes(), start.astype("<i4").tobytes(), sizes.tobytes(), *strings))
    return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)


def open_blocks(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(doc_ids, variants, first words, packed strings) of a bucket's blocks (n, size, block)."""
    codec, parts = pa.Codec("zstd"), ([], [], [], [], [])
    for n, size, block in zip(*(blocks[c].to_pylist() for c in ("n", "size", "block")), strict=True):
        raw = codec.decompress(block, size, asbytes=True)
        for part, kind, at in zip(parts, ("<i8", "<i8", "<i4", "<i4"), (0, 8 * n, 16 * n, 20 * n), strict=False):
            part.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
        parts[4].append(memoryview(raw)[24 * n:])
    doc, variant, start, sizes = map(np.concatenate, parts[:4])
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    packed = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(b"".join(parts[4])))
    return doc, variant, start.astype(np.int64), packed


def packed_blocks(docs: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    """(bucket, n, size, block): the super-k-mers of each slice of documents, one compressed block per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, variants, s in slices(batches):
            light = np.flatnonzero(~np.isin(s.mini, heavy))
            to = (mix64(s.mini[light] + MIX[0]) % np.uint64(buckets)).astype(np.int64)
            light = light[np.argsort(to, kind="stable")]
            to = np.sort(to)
            text, offset = s.packed()
            begin, end = s.begin[light], s.end[light]
            doc, variant, start = ids[s.doc[begin]], variants[s.doc[begin]], s.at[begin]
            strings = [text[a:b] for a, b in zip(offset[begin].tolist(), (offset[end] - 1).tolist(), strict=True)]
            cuts = np.flatnonzero(np.diff(to, prepend=-1, append=-2))
            blocks = [pack_block(doc[a:b], variant[a:b], start[a:b], strings[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(to[cuts[:-1]], pa.int64()), pa.array(np.diff(cuts), pa.int64()), pa.array([x[0] for x in blocks], pa.int64()),
                 pa.array([x[1] for x in blocks], pa.binary())], names=["bucket", "n", "size", "block"])

    return docs.mapInArrow(run, "bucket bigint, n bigint, size bigint, block binary")


def repeated_ranges(doc: np.ndarray, start: np.ndarray, packed: pa.Array, window: int = WINDOW, variant: np.ndarray | None = None) -> pa.Table:
    """Word ranges [start, stop) covered by windows that also start in a smaller doc, among these super-k-mers."""
    variant = np.zeros(len(doc), dtype=np.int64) if variant is None else variant
    words = pc.split_pattern(packed, " ")
    bounds = words.offsets.to_numpy() - words.offsets.to_numpy()[0]
    code = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    count = np.diff(bounds) - (window - 1)
    owner = np.repeat(np.arange(len(doc)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = bounds[owner] + inside
    hashed, word = np.zeros(len(owner), dtype=np.uint64), mix64(code.astype(np.uint64) + MIX[0])
    for j in range(window):
        hashed = hashed * MIX[1] + word[first + j]
    order = np.lexsort((doc[owner], hashed))
    same = np.concatenate([[False], hashed[order][1:] == hashed[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
    pairs = np.flatnonzero(same)
    left, right = first[order[pairs - 1]], first[order[pairs]]
    if not all(np.array_equal(code[left + j], code[right + j]) for j in range(window)):  # a hash collision: sort by the words
        order = np.lexsort((doc[owner], *(code[first + j] for j in range(window))))
        f = first[order]
        same = np.concatenate([[False], np.all([code[f[1:] + j] == code[f[:-1] + j] for j in range(window)], axis=0)])
    group = np.flatnonzero(~same)
    smallest = np.repeat(doc[owner][order][group], np.diff(np.append(group, len(order))))
    flagged = np.zeros(len(owner), dtype=bool)
    flagged[order] = doc[owner][order] > smallest
    new = flagged & ~(np.concatenate([[False], flagged[:-1]]) & (inside > 0))
    last = flagged & ~np.concatenate([flagged[1:] & (inside[1:] > 0), [False]])
    at = start[owner] + inside
    return pa.table({"doc_id": doc[owner][new], "variant": variant[owner][new], "start": at[new], "stop": at[last] + window})


def light_ranges(docs: DataFrame, heavy: np.ndarray, buckets: int) -> DataFrame:
    def bucket(blocks: pa.Table) -> pa.Table:
        doc, variant, start, packed = open_blocks(blocks)
        return repeated_ranges(doc, start, packed, variant=variant)

    return packed_blocks(docs, heavy, buckets).groupBy("bucket").applyInArrow(bucket, RANGES)


def heavy_ranges(docs: DataFrame, heavy: np.ndarray) -> DataFrame:
    """The ranges of windows under ``heavy`` minimisers, window by window: a digest's smallest doc, joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for ids, variants, s in slices(batches):
            of = np.flatnonzero(np.isin(s.mini, heavy))
            count = s.end[of] - s.begin[of] - (WINDOW - 1)
            first = np.repeat(s.begin[of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            text, offset = s.packed()
            digests = [xxh3_128_digest(text[a:b]) for a, b in zip(offset[first].tolist(), (offset[first + WINDOW] - 1).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(ids[s.doc[first]]), pa.array(variants[s.doc[first]]),
                                              pa.array(s.at[first].astype(np.int64))], names=["digest", "doc_id", "variant", "start"])

    windows = stage(docs.mapInArrow(run, "digest binary, doc_id bigint, variant bigint, start bigint"), "heavy-windows")
    smallest = stage(windows.groupBy("digest").agg(F.min("doc_id").alias("smallest")), "heavy-smallest")
    return (windows.join(smallest, "digest").where(F.col("smallest") < F.col("doc_id"))
            .select("doc_id", "variant", "start", (F.col("start") + WINDOW).alias("stop")))


def told_apart(docs: DataFrame) -> DataFrame:
    """(doc_id, text, variant) of every row of ``docs``: variant tells the texts of one doc_id apart, and is 0 where there is one.

    Hashes of all texts find the doc_ids with several texts. If there are any,
    their texts get numbers by digest, and the rows are written once with them.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    hashes = [F.xxhash64("text").alias("a"), F.xxhash64(F.lit("again"), "text").alias("b")]
    several = (rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", *hashes)
               .groupBy("doc_id").agg(*[f(c).alias(n) for c in "ab" for f, n in ((F.min, f"{c}1"), (F.max, f"{c}2"))])
               .where("a1 < a2 OR b1 < b2").select("doc_id"))
    several = stage(several, "ids-of-several-texts")
    if several.isEmpty():
        return rows.withColumn("variant", F.lit(0).cast("long"))
    digest = rows.withColumn("digest", F.sha2("text", 256))
    texts = digest.where("text IS NOT NULL").join(several, "doc_id", "left_semi").select("doc_id", "digest").distinct()
    texts = stage(texts.withColumn("variant", F.monotonically_increasing_id() + 1), "texts-of-an-id")
    found = digest.join(texts, ["doc_id", "digest"], "left")
    return stage(found.select("doc_id", "text", F.coalesce("variant", F.lit(0)).cast("long").alias("variant")), "texts-told-apart")


def repeated_word_ranges(rows: DataFrame) -> DataFrame:
    """(doc_id, variant, start, stop): all word ranges of ``rows`` (doc_id, text, variant) to remove; they may overlap."""
    named = text_session(rows).where("doc_id IS NOT NULL AND text IS NOT NULL")
    total, heavy = minimiser_load(named)
    found = light_ranges(named, heavy, 1 + total // BUCKET_ROWS)
    return found.unionByName(heavy_ranges(named, heavy)) if len(heavy) else found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of ``docs`` (doc_id, text; other columns are ignored).

    kept_text is the words that stay, joined by one space. A null text has no
    words. A null doc_id is smaller than none and larger than none: such rows
    keep all words and take none from others. Rows that repeat a doc_id and its
    text are judged alike; rows with one doc_id and different texts are judged
    each by its own text, and neither is the smaller document. An empty table
    gives no rows.
    """
    rows = told_apart(docs)
    ranges = stage(repeated_word_ranges(rows), "repeated-ranges")
    per_doc = ranges.groupBy("doc_id", "variant").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, starts, stops in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at ASCII white space
                if starts.is_valid and len(words):
                    depth = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(depth, starts.values.to_numpy(), 1)
                    np.add.at(depth, stops.values.to_numpy(), -1)
                    stay = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
                    left = [words[i] for i in stay]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    of = per_doc.select(F.col("doc_id").alias("_id"), F.col("variant").alias("_variant"), "starts", "stops")
    joined = rows.join(of, (F.col("doc_id") == F.col("_id")) & (F.col("variant") == F.col("_variant")), "left")
    return joined.select("doc_id", "text", "starts", "stops").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")
