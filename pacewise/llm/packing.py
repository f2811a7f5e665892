"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. How pieces combine
depends on their lengths only, so the plan is made from the count of each length
(at most ``capacity`` numbers, whatever the input): for the longest length left,
its gap is looked up among the available single lengths, pair sums and triple
sums, and the combination that fills it exactly is consumed as often as its
lengths last. Gaps without an exact filler take the best fit, the longest length
that goes in, and are looked up again. Pieces then find their place by their
rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacewise.llm.common import stage, text_session
from pacewise.llm.sharding import gapless_slots
from pacewise.llm.word_ids import text_ids

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class LengthSums:
    """Available lengths with an index of the sums that pairs of them make."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.astype(np.int64).copy()
        self.size = len(counts)
        self.live = np.zeros(self.size, dtype=bool)
        self.pairs = np.zeros(2 * self.size, dtype=np.int64)  # by sum: pairs of different available lengths
        for length in np.flatnonzero(self.counts):
            self._turn(int(length), True)

    def _turn(self, length: int, on: bool) -> None:
        self.live[length] = False
        others = np.flatnonzero(self.live)
        self.pairs[others + length] += 1 if on else -1
        self.live[length] = on

    def take(self, length: int, n: int) -> None:
        self.counts[length] -= n
        if self.counts[length] == 0:
            self._turn(length, False)

    def has(self, lengths: list[int]) -> bool:
        return all(self.counts[x] >= lengths.count(x) for x in set(lengths))

    def single(self, gap: int, used: list[int]) -> list[int] | None:
        return [gap] if gap < self.size and self.live[gap] and self.has([*used, gap]) else None

    def pair(self, gap: int, used: list[int], most: int) -> list[int] | None:
        half = gap // 2 if gap % 2 == 0 else 0
        if gap < 2 or not (self.pairs[gap] > 0 or (half and self.counts[half] >= 2)):
            return None
        longer = np.arange(min(gap - 1, most), (gap + 1) // 2 - 1, -1)
        for b in longer[self.live[longer] & self.live[gap - longer]]:
            if self.has([*used, int(b), gap - int(b)]):
                return [int(b), gap - int(b)]
        return None

    def triple(self, gap: int, used: list[int]) -> list[int] | None:
        longest = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        rest = gap - longest
        half = np.where(rest % 2 == 0, rest // 2, 0)
        for b in longest[self.live[longest] & ((self.pairs[rest] > 0) | (self.counts[half] >= 2))]:
            found = self.pair(gap - int(b), [*used, int(b)], int(b))
            if found and self.has([*used, int(b), *found]):
                return [int(b), *found]
        return None

    def exact(self, gap: int, used: list[int]) -> list[int] | None:
        return self.single(gap, used) or self.pair(gap, used, self.size - 1) or self.triple(gap, used)

    def best_fit(self, gap: int, used: list[int]) -> int | None:
        for length in np.flatnonzero(self.live[:gap + 1])[::-1]:
            if self.has([*used, int(length)]):
                return int(length)
        return None


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted by length and rank.

    Ranks of one length go to consecutive sequences until the next row begins.
    """
    table = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        table[length] = n
    sums, used = LengthSums(table), np.zeros(capacity + 1, dtype=np.int64)
    rows, sequence = [], 0
    for anchor in range(capacity, 0, -1):
        while sums.counts[anchor]:
            parts, gap = [anchor], capacity - anchor
            while gap:
                exact = sums.exact(gap, parts)
                if exact:
                    parts += exact
                    break
                fit = sums.best_fit(gap, parts)
                if fit is None:
                    break
                parts.append(fit)
                gap -= fit
            times = min(int(sums.counts[x]) // parts.count(x) for x in set(parts))
            offset = 0
            for x in parts:
                rows.append((x, int(used[x]), sequence, offset))
                used[x] += times
                offset += x
            for x in set(parts):
                sums.take(x, times * parts.count(x))
            sequence += times
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 4)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for ``docs`` (doc_id, text): the text's ids and a closing id 0, cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_ids(tokenizer_path)
        for batch in batches:
            doc_ids, rows = batch.column(0).to_pylist(), ([], [], [], [], [])
            for doc_id, ids in zip(doc_ids, encoder.texts(batch.column(1)), strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    for column, x in zip(rows, (doc_id, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_session(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text; other columns are ignored) into sequences.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. A null or empty text is one piece of the closing id;
    only documents longer than ``capacity`` are cut; repeated rows and null
    doc_ids are pieces like any other. An empty table gives no rows.
    """
    cut = stage(pieces(docs, tokenizer_path, capacity), "pieces")
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = packing_plan(lengths, capacity)  # at most `capacity` counts go in, whatever the input
    ranked = gapless_slots(cut, "length", ["doc_id", "piece", "ids_crc32"], slot="rank")
    wide = 1 << 48
    keys = plan[:, 0] * wide + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "rank"))
            row = np.searchsorted(keys, length * wide + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(plan[row, 2] + rank - plan[row, 1]), pa.array(plan[row, 3])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECES + ", sequence_id bigint, offset bigint")
