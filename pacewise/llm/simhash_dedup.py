"""SimHash near-deduplication by the generalised pigeonhole principle.

Fingerprints that differ in at most ``radius`` bits are linked. The 64 bits are
grouped into partitions of correlated bits, and partition i gets a threshold
t_i, with the t_i + 1 adding up to radius + 1: two linked fingerprints then lie
within t_i of each other in at least one partition. Thresholds may differ and
may be -1 (partition not used); a dynamic program picks them, and the number of
partitions, by the probes and the candidates that each choice is estimated to
cost. Candidates meet by an equality join on (partition, masked bits) and are
verified on all 64 bits inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacewise.llm.common import keep_rows, numbered, stage, text_session
from pacewise.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
#: What writing and shuffling a probe costs, in verified candidates.
PROBE_COST = 4.0


def fingerprints(docs: DataFrame, width: int = SHINGLE, rid: Column | None = None) -> DataFrame:
    """(doc_id, rid, fp): the 64-bit SimHash of every text's word shingles, as a signed long.

    A-Z are lower-cased; words are runs of non-white-space; shingles of
    ``width`` words, repeats included, are joined by one space and hashed with
    XXH64 (seed 42). A text with fewer words is one shingle; a null text or one
    without words has fingerprint zero. ``rid`` numbers the rows; if not given, it is made here.
    """

    def simhash(text: str | None) -> int:
        from xxhash import xxh64_intdigest

        # Lower-casing bytes touches A-Z only, and bytes split at ASCII white space only.
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        ends = ends[width - 1:].tolist() or [len(joined)]
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends, strict=False)),
                             dtype="<u8", count=len(ends))
        ones = np.zeros(BITS, dtype=np.int64)
        for k in range(0, len(hashes), 1 << 16):
            bits = np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [simhash(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps, pa.int64())], names=["doc_id", "rid", "fp"])

    rows = text_session(docs).select(F.col("doc_id").cast("long"), (F.monotonically_increasing_id() if rid is None else rid).alias("rid"), "text")
    return rows.mapInArrow(run, "doc_id bigint, rid bigint, fp bigint")


def bit_counts(classes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64), over all of ``classes`` (fp)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = batch.column(0).to_numpy().astype("<i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        i, j = np.indices((BITS, BITS)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)),
                                          pa.array(np.append(total.reshape(-1), n).astype(np.int64))], names=["i", "j", "n"])

    rows = (classes.select("fp").mapInArrow(count, "i bigint, j bigint, n bigint")
            .groupBy("i", "j").agg(F.sum("n").alias("n")).collect())  # 4097 rows
    n, both = 0, np.zeros((BITS, BITS))
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            both[r["i"], r["j"]] = r["n"]
    return n, both


def correlated_groups(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits into ``parts`` groups of near-equal size, each grown around bits that go together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, groups = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - k)
        group = [max(left, key=lambda b: related[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: related[b, group].sum()))
            left.remove(group[-1])
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    """The bits as a signed 64-bit mask."""
    m = sum(1 << b for b in bits)
    return m - (1 << BITS) if m >= 1 << (BITS - 1) else m


def equal_pairs(classes: DataFrame, masks: list[int]) -> list[int]:
    """For every mask, the pairs of fingerprints that agree under it, counted over all of ``classes``."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    sizes = classes.select(keys.alias("k")).groupBy("k.part", "k.key").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.groupBy("part").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).collect()
    found = {r["part"]: r["pairs"] for r in rows}
    return [int(found.get(i, 0)) for i in range(len(masks))]


def candidate_estimates(n: int, p: np.ndarray, bits: list[int], equal: int, radius: int) -> list[float]:
    """Estimated pairs within 0..radius of each other in the partition ``bits``.

    Pairs at distance 0 are the counted ones; farther ones stand to them as in
    the distribution of the distance that the bits' own frequencies give.
    """
    differ = 2 * p[bits] * (1 - p[bits])
    chance = np.zeros(radius + 1)
    chance[0] = 1
    for q in differ:
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    pairs = n * (n - 1) / 2
    base = max(float(equal), pairs * chance[0])
    ratio = chance / max(chance[0], 1e-300)
    return np.minimum(np.cumsum(base * ratio), pairs).tolist()


@dataclass(frozen=True)
class Partition:
    bits: tuple[int, ...]
    threshold: int

    @property
    def flips(self) -> list[int]:
        """Every change of at most ``threshold`` of the bits, as masks; the first is no change."""
        return [mask_of(list(c)) for t in range(self.threshold + 1) for c in combinations(self.bits, t)]


def allocate(groups: list[list[int]], estimates: list[list[float]], n: int, radius: int) -> tuple[float, list[Partition]]:
    """The thresholds of least cost whose t + 1 add up to radius + 1: a dynamic program over the partitions."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for bits, candidates in zip(groups, estimates, strict=True):
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for given, (cost, chosen) in best.items():
            for t in range(-1, min(radius - given, len(bits)) + 1):
                probes = sum(comb(len(bits), k) for k in range(t + 1)) if t >= 0 else 0
                more = cost + (PROBE_COST * n * (probes + 1) + candidates[t] if t >= 0 else 0)
                if given + t + 1 not in step or more < step[given + t + 1][0]:
                    step[given + t + 1] = (more, (*chosen, t))
        best = step
    cost, chosen = best[radius + 1]
    return cost, [Partition(tuple(b), t) for b, t in zip(groups, chosen, strict=True) if t >= 0]


def plan_partitions(classes: DataFrame, radius: int = RADIUS) -> list[Partition]:
    """Partitions and thresholds for the fingerprints of ``classes`` (distinct fp)."""
    n, both = bit_counts(classes)
    p = np.diag(both) / max(n, 1)
    choices = [correlated_groups(n, both, m) for m in range(1, radius + 2)]
    masks = [mask_of(g) for groups in choices for g in groups]
    equal = iter(equal_pairs(classes, masks))
    costed = [allocate(groups, [candidate_estimates(n, p, g, next(equal), radius) for g in groups], n, radius) for groups in choices]
    return min(costed, key=lambda c: c[0])[1]


def near_links(classes: DataFrame, plan: list[Partition], radius: int = RADIUS) -> DataFrame:
    """Distinct pairs (a < b) of fingerprints at most ``radius`` bits apart."""

    def key(i: int, p: Partition, flip: Column | None = None) -> Column:
        masked = F.col("fp").bitwiseAND(F.lit(mask_of(list(p.bits))))
        return F.struct(F.lit(i).alias("part"), (masked if flip is None else masked.bitwiseXOR(flip)).alias("key"))

    index = classes.select(F.col("fp").alias("b"), F.explode(F.array(*[key(i, p) for i, p in enumerate(plan)])).alias("k"))

    def flipped(i: int, p: Partition) -> Column:
        return F.transform(F.array(*[F.lit(x).cast("long") for x in p.flips]), lambda x: key(i, p, x))

    # A partition of threshold 0 costs one probe, one of threshold 1 as many more as it has bits.
    probes = F.concat(*[flipped(i, p) for i, p in enumerate(plan)])
    probe = classes.select(F.col("fp").alias("a"), F.explode(probes).alias("k"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    met = (probe.select("a", "k.part", "k.key").alias("p")
           .join(index.select("b", "k.part", "k.key").alias("i"),
                 (F.col("p.part") == F.col("i.part")) & (F.col("p.key") == F.col("i.key")) & near))
    return met.select("a", "b").distinct()


def near_components(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, rid: Column | None = None) -> DataFrame:
    """doc_id, rid, fp, root, component_id (the smallest doc_id reachable by links, itself included) per row of ``docs``.

    ``root`` names the component by its smallest fingerprint; ``rid`` numbers
    the rows.

    Texts with one fingerprint are one node, however many they are. Null and
    empty texts share fingerprint zero; repeated rows stay; a null doc_id is
    never a component's name unless all its doc_ids are null. An empty table
    gives no rows.
    """
    fps = stage(fingerprints(docs, width, rid), "fingerprints")
    classes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-classes")
    links = stage(near_links(classes, plan_partitions(classes, radius), radius), "near-links")
    rooted = classes.join(components(links), F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = stage(rooted, "rooted-classes")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stage(rooted.select("fp", "root").join(stage(names, "component-names"), "root").select("fp", "root", "component_id"), "class-components")
    return fps.join(named, "fp").select("doc_id", "rid", "fp", "root", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))



def keep_one(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` per component, the one with the smallest doc_id, with all its columns."""
    rows = numbered(docs)
    found = near_components(rows.select("_row.doc_id", "_row.text", "rid"), radius, width, F.col("rid"))
    last = F.lit((1 << 63) - 1)
    kept = found.groupBy("root").agg(F.min_by("rid", F.coalesce("doc_id", last)).alias("rid"))
    return keep_rows(rows, kept)
