"""Language-model scores from a log-frequency Bloom filter.

The filter holds, for every n-gram of the training texts, its count on a
logarithmic scale: an n-gram of level j is entered as (n-gram, 1) to
(n-gram, j), and read back by probing levels until one is missing. Counts are
exact up to 10 and within a tenth beyond; a false positive can only make a count
greater.

A word's probability is its count after the words before it, smoothed towards the
shorter context with a Dirichlet prior, down to add-one over single words.
Numerators take the least count of a level and contexts the greatest, so the
probabilities of all words after a context sum to one at most, but for false
positives.

The filter is a row of segments by n-gram hash, each as large as its entries need.
If they fit BROADCAST_BYTES they are broadcast; otherwise the n-grams of each slice
of texts go to the segments, are probed there once for all slices, and come back
with their levels. Both read the same bits and give the same scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.llm.common import stage, text_session
from pacewise.llm.substring_dedup import mix64, split_words

ORDER = 2
#: Weight of the shorter context, in counts: the best of 1 to 1,000 on a seventh of the training texts of sf0.1, learnt from the rest.
PRIOR = 300.0
#: Each level's least count is about so many times the one below.
BASE = 1.1
#: Bits an entry, of which it sets (up to) MARKS in one 64-bit word.
ENTRY_BITS = 11
MARKS = 5
BROADCAST_BYTES = 192 << 20
#: Text of one slice, and text whose n-grams share a segment (and whose words share a bucket).
SLICE_BYTES = 4 << 20
SEGMENT_CHARS = 16 << 20
#: N-grams that are merged before they go to the segments, and that a segment probes at a time.
MERGED = 2_000_000
#: Words (of all slices) that share a bucket.
BUCKET_WORDS = 500_000
#: N-grams of this level and more whose level a worker remembers from text to text (probing them is most of the work), and how many.
FREQUENT = 16
REMEMBERED = 1 << 20
#: N-grams are told apart by so many bits within their segment.
RESIDUAL = 40
MIX = np.uint64(0x9E3779B97F4A7C15)
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def codebook(base: float = BASE) -> np.ndarray:
    """The least count of every level, from level 0 (none) on; the last is beyond any count."""
    least = [0, 1]
    while least[-1] < 1 << 52:
        least.append(max(least[-1] + 1, int(least[-1] * base)))
    return np.asarray(least, dtype=np.int64)


LEAST = codebook()
MOST = np.append(LEAST[1:] - 1, LEAST[-1])  # the greatest count of every level
BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
TWO_BITS = (BIT[:, None] | BIT).ravel()  # the marks of twelve bits of a hash


@dataclass
class Slice:
    """Some texts as numbers of their distinct words."""

    ids: np.ndarray
    size: np.ndarray  # words by text
    hashed: np.ndarray  # by word number

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all texts' tokens, each text between BEGIN and END, and every token's place in its text."""
        whole = self.size + 2
        first = np.cumsum(whole) - whole
        out = np.empty(int(whole.sum()), dtype=np.uint64)
        place = np.arange(len(out)) - np.repeat(first, whole)
        out[first], out[first + whole - 1] = BEGIN, END
        out[(place > 0) & (place < np.repeat(whole, whole) - 1)] = self.hashed[self.ids]
        return out, place


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))


def gram_hashes(run: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, hash) of the n-grams of a run that lie in one text."""
    end = np.flatnonzero(place >= n - 1)
    h = np.full(len(end), n, dtype=np.uint64)
    for j in range(n - 1, -1, -1):
        h = mix64(h * MIX + run[end - j])
    return end, h


def distinct_grams(texts: Slice, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a slice's distinct n-grams of 1 to ``order`` tokens, ascending, and their counts."""
    run, place = texts.run()
    return np.unique(np.concatenate([gram_hashes(run, place, n)[1] for n in range(1, order + 1)]), return_counts=True)


def split_hash(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """An n-gram's segment and its residual in it."""
    return (mix64(h + MIX) % np.uint64(segments)).astype(np.int64), h >> np.uint64(64 - RESIDUAL)


def by_segment(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order by (segment, residual) of ascending hashes, the segments that occur, where each begins and ends, and the sorted residuals."""
    segment, residual = split_hash(h, segments)
    order = np.argsort(segment.astype(np.min_scalar_type(segments)), kind="stable")  # residuals ascend with their hashes
    cuts = np.flatnonzero(np.diff(segment[order], prepend=-1, append=-2))
    return order, segment[order][cuts[:-1]], cuts, residual[order]


def pack_residuals(residual: np.ndarray, count: np.ndarray | None = None) -> tuple[int, bytes]:
    """Ascending residuals as differences, byte by byte, then counts."""
    planes = np.diff(residual, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(RESIDUAL + 7) // 8]
    raw = np.ascontiguousarray(planes.T).tobytes() + (b"" if count is None else count.astype("<u4").tobytes())
    return len(raw), pa.Codec("zstd").compress(raw, asbytes=True)


def open_residuals(n: int, size: int, block: bytes, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(block, size, asbytes=True)
    width = (RESIDUAL + 7) // 8
    planes = np.zeros((n, 8), dtype=np.uint8)
    planes[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=width * n).reshape(width, n).T
    return np.cumsum(planes.view("<u8")[:, 0], dtype=np.uint64), np.frombuffer(raw, dtype="<u4", count=n if counted else 0, offset=width * n)


def places(residual: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """An entry's word, before the remainder by a segment's size, and its marks in it: a membership probe reads one word."""
    word = mix64(residual * MIX + np.uint64(level))
    more, marks = mix64(word), np.zeros(len(residual), dtype=np.uint64)
    for k in range(0, MARKS, 2):
        table, some = (TWO_BITS, 4095) if k + 1 < MARKS else (BIT, 63)
        marks |= table[(more >> np.uint64(6 * k) & np.uint64(some)).view(np.int64)]
    return word, marks


def build_segment(residual: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The words of a filter with every n-gram (residuals may repeat) at the level of its summed count."""
    order = np.argsort(residual)
    first = np.flatnonzero(np.diff(residual[order], prepend=np.uint64(1 << 63)) != 0)
    residual, total = residual[order][first], np.add.reduceat(count[order].astype(np.int64), first)
    level = np.searchsorted(LEAST, total, side="right") - 1
    out = np.zeros(1 + int(level.sum()) * ENTRY_BITS // 64, dtype=np.uint64)
    for j in range(1, int(level.max(initial=0)) + 1):
        word, marks = places(residual[level >= j], j)
        np.bitwise_or.at(out, (word % np.uint64(len(out))).astype(np.int64), marks)
    return out


class LogFrequencyFilter:
    """Segments of a filter as one array of words; ``segment[i]`` begins at ``begin[i]`` and has ``size[i]`` words."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.begin, self.size = (np.cumsum(sizes) - sizes).astype(np.uint64), sizes.astype(np.uint64)
        self.words = np.zeros(int(sizes.sum()), dtype="<u8")
        self.known, self.known_levels = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def put(self, segment: int, words: bytes) -> None:
        at = int(self.begin[segment])
        self.words[at:at + len(words) // 8] = np.frombuffer(words, dtype="<u8")

    def levels(self, segment: np.ndarray, residual: np.ndarray) -> np.ndarray:
        """The highest level up to which all entries of an n-gram are found, by probing one level after the other."""
        out, todo = np.full(len(residual), len(LEAST) - 1, dtype=np.int64), np.arange(len(residual))
        begin, size = self.begin[segment], self.size[segment]
        for j in range(1, len(LEAST)):
            word, marks = places(residual, j)
            there = self.words[begin + word % size] & marks == marks
            if not there.all():
                out[todo[~there]] = j - 1
                todo, residual, begin, size = (x[there] for x in (todo, residual, begin, size))
                if not len(todo):
                    break
        return out

    def levels_again(self, h: np.ndarray) -> np.ndarray:
        """The levels of ascending hashes; frequent ones are probed when they are first met and remembered."""
        at = np.searchsorted(self.known, h)
        met = at < len(self.known)
        met[met] = self.known[at[met]] == h[met]
        out, new = np.zeros(len(h), dtype=np.int64), np.flatnonzero(~met)
        out[met] = self.known_levels[at[met]]
        out[new] = self.levels(*split_hash(h[new], len(self.size)))
        kept = new[out[new] >= FREQUENT][:REMEMBERED - len(self.known)]
        self.known, self.known_levels = np.insert(self.known, at[kept], h[kept]), np.insert(self.known_levels, at[kept], out[kept])
        return out


def in_test(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


SLICE = "slice bigint, doc_ids array<bigint>, held_out array<boolean>, sizes array<bigint>, ids binary, words binary, n_words bigint"


def zipped(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + (pa.Codec("zstd").compress(raw, asbytes=True) if raw else b"")


def unzipped(block: bytes) -> bytes:
    size = int.from_bytes(block[:8], "little")
    return pa.Codec("zstd").decompress(block[8:], size, asbytes=True) if size else b""


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def encode(docs: DataFrame) -> DataFrame:
    """One row per slice of ``docs`` (doc_id, text, held_out): the texts as numbers of the slice's distinct words.

    Slices are numbered by task; the table is to be staged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for own in batches:
            texts = pc.fill_null(own.column(1).cast(pa.large_string()), "")
            block = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                words, size = split_words(pc.ascii_lower(texts.slice(a, b - a)))
                coded = words.dictionary_encode()
                spelled, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict({
                    "slice": [number], "doc_ids": [own.column(0).slice(a, b - a).to_pylist()], "held_out": [own.column(2).slice(a, b - a).to_pylist()],
                    "sizes": [size.tolist()], "ids": [zipped(planes(ids))], "words": [zipped(" ".join(spelled).encode())], "n_words": [len(spelled)],
                }, schema=pa.schema([("slice", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
                                     ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("words", pa.binary()), ("n_words", pa.int64())]))
                number += 1

    return text_session(docs).select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(run, SLICE)


def open_slice(row: dict) -> tuple[Slice, list[bytes]]:
    """A slice and its words (a word has no space)."""
    words = unzipped(row["words"]).split(b" ") if row["n_words"] else []
    return Slice(from_planes(unzipped(row["ids"])), np.asarray(row["sizes"], dtype=np.int64), word_hashes(words)), words


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Slice, list[bytes]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield row, *open_slice(row)


def learnt(row: dict, texts: Slice) -> Slice:
    """The training texts of a slice."""
    kept = ~np.asarray(row["held_out"], dtype=bool)
    return Slice(texts.ids[np.repeat(kept, texts.size)], texts.size[kept], texts.hashed)


def buckets_of(hashed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers by bucket, the buckets that occur, and where each begins and ends."""
    to = (mix64(hashed * MIX) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1, append=-2))
    return order, to[order][cuts[:-1]], cuts


def word_totals(slices: DataFrame, buckets: int) -> DataFrame:
    """(slice, bucket, counts): the training counts of each slice's words, summed over all slices.

    A slice's words go to buckets with their counts in the slice; a bucket adds up
    and answers every slice. Each bucket has one more row, without slice, with
    ``tokens`` and ``types``, the sum and the number of its counts.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts, words in opened(batches):
            times = np.bincount(learnt(row, texts).ids, minlength=len(words))
            order, found, cuts = buckets_of(texts.hashed, buckets)
            parts = [order[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["slice"]] * len(parts), pa.int64()), pa.array(found), pa.array([zipped(b" ".join([words[i] for i in x])) for x in parts], pa.binary()),
                     pa.array([zipped(planes(times[x])) for x in parts], pa.binary())], names=["slice", "bucket", "words", "times"])

    def answer(table: pa.Table) -> pa.Table:
        spelled = pa.array([unzipped(x.as_py()).decode() for x in table["words"]], pa.large_string())
        words = pc.split_pattern(spelled, " ")
        ids = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        total = np.bincount(ids, weights=np.concatenate([from_planes(unzipped(x.as_py())) for x in table["times"]])).astype(np.int64)
        ends = words.offsets.to_numpy() - words.offsets.to_numpy()[0]
        bucket = table["bucket"][0].as_py()
        rows = [(x, bucket, zipped(total[ids[a:b]].astype("<i8").tobytes()), None, None)
                for x, a, b in zip(table["slice"].to_pylist(), ends.tolist(), ends[1:].tolist(), strict=False)]
        rows.append((None, bucket, None, int(total.sum()), int((total > 0).sum())))
        kinds = [("slice", pa.int64()), ("bucket", pa.int64()), ("counts", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64())]
        return pa.table([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], names=[x for x, _ in kinds])

    sent = slices.mapInArrow(send, "slice bigint, bucket bigint, words binary, times binary")
    return sent.groupBy("bucket").applyInArrow(answer, "slice bigint, bucket bigint, counts binary, tokens bigint, types bigint")


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and summed counts of several (hashes, counts)."""
    h, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[:len(h)])
    return h[first], np.add.reduceat(count[order], first) if len(first) else count


def filter_segments(slices: DataFrame, segments: int, order: int = ORDER, merged: int = MERGED) -> DataFrame:
    """(segment, filter) of the training n-grams of 1 to ``order`` tokens.

    A task merges its slices' n-grams, ``merged`` at a time, before they go to the segments.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            h, count = merged_counts(held)
            held.clear()
            at, found, ends, residual = by_segment(h, segments)
            parts = [pack_residuals(residual[x:y], count[at[x:y]]) for x, y in zip(ends, ends[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array([x[0] for x in parts], pa.int64()),
                                               pa.array([x[1] for x in parts], pa.binary())], names=["segment", "n", "size", "block"])

        for row, texts, _ in opened(batches):
            held.append(distinct_grams(learnt(row, texts), order))
            if sum(len(h) for h, _ in held) >= merged:
                yield sent()
        if held:
            yield sent()

    def build(table: pa.Table) -> pa.Table:
        blocks = [open_residuals(*row) for row in zip(*(table[c].to_pylist() for c in ("n", "size", "block")), strict=True)]
        made = build_segment(np.concatenate([x[0] for x in blocks]), np.concatenate([x[1] for x in blocks]))
        return pa.table({"segment": table["segment"].slice(0, 1), "filter": pa.array([made.tobytes()], pa.binary())})

    sent = slices.mapInArrow(send, "segment bigint, n bigint, size bigint, block binary")
    return sent.groupBy("segment").applyInArrow(build, "segment bigint, filter binary")


Levels = Callable[[int, np.ndarray, np.ndarray], np.ndarray]


def text_scores(texts: Slice, levels: Levels, tokens: int, types: int, order: int = ORDER, prior: float = PRIOR) -> np.ndarray:
    """log10 probability of each text; ``levels(n, hashes, wanted)`` gives the levels of distinct n-grams (0 unless wanted)."""
    run, place = texts.run()
    p, shorter = np.ones(len(run)), np.zeros(len(run), dtype=np.int64)
    for n in range(1, order + 1):
        end, h = gram_hashes(run, place, n)
        unique, at = np.unique(h, return_inverse=True)
        there = np.ones(len(unique), dtype=bool)
        if n > 1:
            there[at] = (shorter[end] > 0) & (shorter[end - 1] > 0)  # the same wherever the n-gram stands
        level = np.where(there, levels(n, unique, there), 0)[at]
        if n == 1:
            p[end] = (LEAST[level] + 1) / (tokens + types + 1)
        else:
            context = MOST[shorter[end - 1]] * (shorter[end - 1] > 0)
            p[end] = (np.minimum(LEAST[level], context) + prior * p[end]) / (context + prior)
        shorter = np.zeros(len(run), dtype=np.int64)
        shorter[end] = level
    logs = np.where(place > 0, np.log10(p), 0.0)
    whole = texts.size + 2
    return np.add.reduceat(logs, np.cumsum(whole) - whole)


def routed_levels(slices: DataFrame, segments: DataFrame, count: int, order: int = ORDER, at_once: int = MERGED) -> DataFrame:
    """(slice, segment, levels): the levels of every slice's distinct n-grams, read where their segment lies.

    A segment probes an n-gram once for all slices that ask together, ``at_once`` n-grams of theirs (or one slice's) at a time.
    """

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts, _ in opened(batches):
            _, found, ends, residual = by_segment(distinct_grams(texts, order)[0], count)
            parts = [pack_residuals(residual[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["slice"]] * len(parts), pa.int64()), pa.array(found), pa.array(np.diff(ends)),
                     pa.array([x[0] for x in parts], pa.int64()), pa.array([x[1] for x in parts], pa.binary())],
                    names=["slice", "segment", "n", "size", "block"])

    def answer(asked: pa.Table, held: pa.Table) -> pa.Table:
        levels, sizes = [], asked["n"].to_numpy()
        words = held["filter"][0].as_py() if len(held) else bytes(8)  # a segment without entries is an empty word
        own = LogFrequencyFilter(np.asarray([len(words) // 8]))
        own.put(0, words)
        together = np.cumsum(sizes) // at_once
        cuts = [0, *(np.flatnonzero(np.diff(together)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                blocks = zip(*(asked[c].slice(a, b - a).to_pylist() for c in ("n", "size", "block")), strict=True)
                unique, at = np.unique(np.concatenate([open_residuals(*x, counted=False)[0] for x in blocks]), return_inverse=True)
                level = own.levels(np.zeros(len(unique), dtype=np.int64), unique)[at].astype("<u2")
                ends = np.cumsum(sizes[a:b])
                levels += [level[x:y].tobytes() for x, y in zip(ends - sizes[a:b], ends, strict=True)]
        return pa.table({"slice": asked["slice"], "segment": asked["segment"], "levels": pa.array(levels, pa.binary())})

    sent = slices.mapInArrow(probes, "slice bigint, segment bigint, n bigint, size bigint, block binary")
    return sent.groupBy("segment").cogroup(segments.groupBy("segment")).applyInArrow(answer, "slice bigint, segment bigint, levels binary")


def language_scores(docs: DataFrame, order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    A-Z are lower-cased; a text's tokens are its words and one end. All texts but
    the held-out ones are learnt from. ``base_score`` is the add-one score from
    exact counts of single words, ``score`` the filter's. A null or empty text is
    its end alone; a null doc_id is held out or not as an empty one; other columns
    are ignored; repeated rows are learnt and scored each. Without training texts
    every count is zero. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", in_test(F.col("doc_id")).alias("held_out"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(~F.col("held_out")).alias("learnt")).first()
    segments = 1 + total["chars"] // segment_chars
    slices = stage(encode(rows), "coded-slices")
    filters = stage(filter_segments(slices, segments, order), "filter-segments")
    buckets = 1 + slices.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0] // BUCKET_WORDS
    totals = stage(word_totals(slices, buckets), "word-totals")
    sums = totals.where("slice IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    tokens, types = sums["tokens"] + total["learnt"], sums["types"] + (total["learnt"] > 0)
    added = totals.where("slice IS NOT NULL").select(F.col("slice").alias("of"), "bucket", "counts")

    held = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if held <= broadcast_bytes:
        sizes = np.ones(segments, dtype=np.int64)  # a segment without entries is an empty word
        for row in filters.select("segment", (F.length("filter") / 8).cast("long").alias("words")).collect():
            sizes[row["segment"]] = row["words"]
        whole = LogFrequencyFilter(sizes)
        for row in filters.toLocalIterator():  # broadcast_bytes in all, a part at a time
            whole.put(row["segment"], bytes(row["filter"]))
        shared = spark.sparkContext.broadcast(whole)
        added = added.select("*", F.lit(None).cast("long").alias("segment"), F.lit(None).cast("binary").alias("levels"))
    else:
        shared = None
        added = added.unionByName(routed_levels(slices, filters, segments, order).withColumnRenamed("slice", "of"), allowMissingColumns=True)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({x: pa.array([], t) for x, t in zip(names, kinds, strict=True)})
        row = left.to_pylist()[0]
        texts, _ = open_slice(row)
        c = np.zeros(len(texts.hashed), dtype=np.int64)
        answers, counts = {}, {}
        for x in right.to_pylist():
            if x["counts"] is not None:
                counts[x["bucket"]] = np.frombuffer(unzipped(x["counts"]), dtype="<i8")
            else:
                answers[x["segment"]] = np.frombuffer(x["levels"], dtype="<u2")
        at, present, _ = buckets_of(texts.hashed, buckets)
        if len(at):
            c[at] = np.concatenate([counts[x] for x in present.tolist()])

        if shared is None:
            every = distinct_grams(texts, order)[0]
            order_of, asked, _, _ = by_segment(every, segments)
            told = np.zeros(len(every), dtype=np.int64)
            if len(asked):
                told[order_of] = np.concatenate([answers[x] for x in asked.tolist()])

        def levels(n: int, h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            if shared is None:
                return told[np.searchsorted(every, h)]
            out = np.zeros(len(h), dtype=np.int64)
            out[wanted] = shared.value.levels_again(h[wanted])
            return out

        owner = np.repeat(np.arange(len(texts.size)), texts.size)
        add_one = lambda x: np.log10((x + 1.0) / (tokens + types + 1))
        base = np.bincount(owner, weights=add_one(c)[texts.ids], minlength=len(texts.size)) + add_one(total["learnt"])
        seen = np.bincount(owner, weights=(c > 0)[texts.ids], minlength=len(texts.size)).astype(np.int64) + (total["learnt"] > 0)
        made = [row["doc_ids"], row["held_out"], texts.size + 1, seen, np.full(len(texts.size), tokens), base, text_scores(texts, levels, tokens, types, order)]
        return pa.table({x: pa.array(v, t) for x, v, t in zip(names, made, kinds, strict=True)})

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return slices.groupBy("slice").cogroup(added.groupBy("of")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
