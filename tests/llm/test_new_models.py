"""Collocations, spelling variants and Bloom filter scores against brute force."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacewise.llm import bloom_lm, collocations, spelling
from tests.llm.fixtures import AWKWARD, SCHEMA, SF, docs, given, words, written

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(frame):
    return [(r["doc_id"], r["text"], r["lang"]) for r in frame.select("doc_id", "text", "lang").collect()]


# ---- collocations

def brute_collocations(rows, least=10, top=2000):
    one, two, three, total = Counter(), Counter(), Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            one.update((lang, x) for x in w)
            two.update((lang, *x) for x in zip(w, w[1:]))
            three.update((lang, *x) for x in zip(w, w[1:], w[2:]))
    often = {k: f for c in (two, three) for k, f in c.items() if f >= least}
    around = defaultdict(int)
    for k, f in often.items():
        if len(k) == 4:
            for part in (k[:3], (k[0], *k[2:])):
                around[part] = max(around[part], f)
    found = defaultdict(list)
    for k, a in often.items():
        if len(k) == 3 and 100 * around[k] >= 50 * a:
            continue
        count = lambda p: (one if len(p) == 2 else two)[p]
        cuts = []
        for at in range(2, len(k)):
            left, right = count(k[:at]), count((k[0], *k[at:]))
            cuts.append((1_000_000 * a * a // (left * right), at, left, right))
        score, _, left, right = min(cuts)
        found[k[0]].append((-score, -a, " ".join(k[1:]).encode(), left, right))
    return {(lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score)
            for lang, own in found.items() for i, (score, a, phrase, left, right) in enumerate(sorted(own)[:top])}


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = given(spark, "documents", SF).unionByName(docs(spark))
    expected = brute_collocations(rows_of(rows), least=5, top=50)
    found = collocations.collocations(rows, least=5, top=50)
    assert found.columns == NAMES and {tuple(r) for r in found.collect()} == expected and len(expected) > 50
    monkeypatch.setattr(collocations, "BUCKET_CHARS", 40_000)  # more buckets, and a shard per file split
    rows = rows.repartition(7)
    assert {tuple(r) for r in collocations.collocations(rows, least=5, top=50).collect()} == expected


def test_collocations_of_odd_rows(spark):
    rows = [(i, "Alpha beta. alpha beta gamma", None, "s", 0) for i in range(12)]
    rows += [(100 + i, "und here\talpha beta\nalpha", "und", "s", 0) for i in range(3)] + [(None, "é é é é é é é é é é é", "fr", None, 0)]
    found = collocations.collocations(docs(spark, rows + AWKWARD, clashing=True)).collect()
    assert {tuple(r) for r in found} == brute_collocations([r[:3] for r in rows + AWKWARD])
    assert {r["lang"] for r in found} >= {"und", "fr"}
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(docs(spark, [(1, "..., ;\n", "en", None, 0)])).collect() == []


def test_word_index_counts_and_extensions():
    rng = np.random.default_rng(5)
    run = np.append(rng.integers(0, 6, 500), 0)
    index = collocations.WordIndex(run)
    for k, p in enumerate(index.phrases(), 1):
        brute = Counter(tuple(run[i:i + k]) for i in range(len(run) - k + 1) if 0 not in run[i:i + k])
        assert dict(zip(zip(*(w.tolist() for w in p.words)), p.size.tolist())) == brute
    two = index.right(index.single())
    again = index.left(index.single())
    assert set(zip(*(w.tolist() for w in two.words), two.low.tolist(), two.reverse_low.tolist(), two.size.tolist())) == \
        set(zip(*(w.tolist() for w in again.words), again.low.tolist(), again.reverse_low.tolist(), again.size.tolist()))


def test_hash_bits_hold_every_hash(spark, monkeypatch):
    hashed = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 60_000, dtype=np.int64)
    frame = spark.createDataFrame([(int(x),) for x in hashed], "hash bigint")
    other = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 60_000, dtype=np.int64)
    bits = collocations.hash_bits(frame, 16)
    assert collocations.has_bit(bits, hashed.view(np.uint64)).all() and collocations.has_bit(bits, other.view(np.uint64)).mean() < 0.1
    monkeypatch.setattr(collocations, "FILTER_BYTES", 5_000)  # full: others pass too, none is lost
    small = collocations.hash_bits(frame, 16)
    assert len(small) == 5_000 and collocations.has_bit(small, hashed.view(np.uint64)).all()


def test_full_tables_change_no_result(spark, monkeypatch):
    rows = given(spark, "documents", SF)
    monkeypatch.setattr(collocations, "FILTER_BYTES", 64)
    found = {tuple(r) for r in collocations.collocations(rows, least=5, top=50).collect()}
    assert found == brute_collocations(rows_of(rows), least=5, top=50)


def test_blocks_of_many_words_and_the_wide_key(monkeypatch):
    import pyarrow as pa

    hashed = np.arange(50, dtype=np.uint64) * np.uint64(1 << 58)
    columns = [np.array([1, 2, 2]), np.array([3, 3, 4]), np.array([5, 5, 5])]
    ids, size, block = collocations.pack_block(columns, np.array([4, 6, 1]), hashed)
    table = pa.table({"width": [3, 3], "n": [3, 3], "ids": [ids] * 2, "size": [size] * 2, "block": [block] * 2})
    found = collocations.add_up(table, 8).to_pylist()
    assert [(r["f"]) for r in found] == [8, 12]
    assert [np.int64(r["h1"]).view(np.uint64) for r in found] == [hashed[1], hashed[2]]


def test_scores_beyond_64_bits(spark):
    big = 10**14
    row = spark.sql(f"SELECT {big}L AS a, {big + 1}L AS l, {3 * big}L AS r").select(collocations.cut_score("a", "l", "r").alias("s")).first()
    assert row["s"] == 1_000_000 * big * big // ((big + 1) * 3 * big)


# ---- spelling variants

def brute_spelling(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(UPPER)
            h = crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            n[low] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    holes = defaultdict(list)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1:]].append(w)
    near = defaultdict(set)
    for own in holes.values():
        for w in own:
            near[w].update(x for x in own if x != w)
    for w in n:
        for i in range(len(w)):
            x = w[:i] + w[i + 1:]
            if x in n:
                near[w].add(x)
                near[x].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


CLUSTER = " ".join(["straße"] * 9 + ["strasse"] * 40 + ["strase"] * 4 + ["strasses"] * 3 + ["Àstrasse"] * 3 + ["hello"] * 20 + ["hallo"] * 10
                   + ["hullo"] * 10 + ["helo"] * 9 + ["helloo"] * 3 + ["hellooo"] * 3 + ["aaaaa"] * 6 + ["aaaaaa"] * 3 + ["ababab"] * 3 + ["bababa"] * 3)


@pytest.mark.parametrize("group", [5_000, 2])
def test_spelling_variants_equal_brute_force(spark, group):
    rows = docs(spark, [(77, CLUSTER, "de", "s", 0), (None, CLUSTER, None, None, 0)]).unionByName(docs(spark))
    if group > 2:
        rows = rows.unionByName(given(spark, "documents", SF))
    found = spelling.spelling_variants(rows, group)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spelling(rows_of(rows))
    assert any(f for _, f, *_ in got)


def test_partitions_are_halved_and_stay_within_bounds(spark):
    made = [("ab" + chr(97 + i) + chr(97 + j) + "cde", 3) for i in range(20) for j in range(20)] + [("x" * 300, 5), ("x" * 299, 50), ("x" * 150 + "y" + "x" * 149, 9)]
    vocabulary = spark.createDataFrame(made, "word string, n bigint")
    parts = spelling.partitions(vocabulary, 50)
    sizes = parts.groupBy(*spelling.KEY).count().collect()
    assert all(r["count"] <= 50 or r["high"] - r["low"] == 1 for r in sizes)
    assert all(r["high"] - r["low"] <= spelling.PLACES or r["count"] == 1 for r in sizes)
    found = sorted((r["word"], r["near"]) for r in spelling.near_pairs(vocabulary, 50).collect())
    own = [w for w, _ in made]
    # Same third or same fourth letter: 400 words with 19 + 19 near ones each, and three pairs of the long ones.
    assert len(found) == len(set(found)) == 400 * 38 + 6 and {a for a, _ in found} == set(own)


def test_spelling_of_odd_rows(spark):
    clashing = docs(spark, AWKWARD + [(50, CLUSTER, "en", "s", 0), (51, "z" * 5000 + " " + "z" * 5000 + " " + "z" * 5001 + " " + "z" * 5000, "en", "s", 0)] * 3, clashing=True)
    got = {tuple(r) for r in spelling.spelling_variants(clashing).collect()}
    assert got == brute_spelling(rows_of(clashing))
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- Bloom filter scores

def brute_scores(rows, prior=bloom_lm.PRIOR):
    """Base scores, and the scores of the same smoothing from exact counts."""
    seen = [(d, ["<s>", *[w.translate(UPPER) for w in words(t)], "</s>"], crc32(str("" if d is None else d).encode()) % 7 == 2) for d, t, *_ in rows]
    one, two = Counter(), Counter()
    for _, tokens, held in seen:
        if not held:
            one.update(tokens)
            two.update(zip(tokens, tokens[1:]))
    count = {k: v for k, v in one.items() if k != "<s>"}
    total, types = sum(count.values()), len(count)
    out = []
    for d, tokens, held in seen:
        base = sum(math.log10((count.get(w, 0) + 1) / (total + types + 1)) for w in tokens[1:])
        score = sum(math.log10((two[v, w] + prior * (count.get(w, 0) + 1) / (total + types + 1)) / (one[v] + prior)) for v, w in zip(tokens, tokens[1:]))
        out.append((d, held, len(tokens) - 1, sum(w in count for w in tokens[1:]), total, base, score))
    return out


def keyed(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[5]))


@pytest.fixture(scope="module")
def scored(spark):
    rows = given(spark, "documents", SF).unionByName(docs(spark))
    return rows, keyed([tuple(r) for r in bloom_lm.language_scores(rows).collect()])


def test_base_scores_are_exact_and_scores_close_to_exact_counts(scored):
    rows, found = scored
    expected = keyed(brute_scores(rows_of(rows)))
    assert len(found) == len(expected)
    for got, own in zip(found, expected):
        assert got[:5] == own[:5] and math.isclose(got[5], own[5], rel_tol=1e-9)
        # Counts are at most a tenth off, so a token's probability is within some hundredths; false positives only raise it.
        assert abs(got[6] - own[6]) <= 0.1 * own[2]
    held = [r for r in found if r[1] and r[2] > 50]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_routed_probes_give_the_broadcast_scores(scored):
    rows, found = scored
    routed = bloom_lm.language_scores(rows, broadcast_bytes=0)
    assert keyed([tuple(r) for r in routed.collect()]) == found


def test_many_segments_and_small_slices(spark, scored):
    rows, found = scored
    other = keyed([tuple(r) for r in bloom_lm.language_scores(rows, segment_chars=20_000).collect()])
    assert [r[:6] for r in other] == [r[:6] for r in found]
    routed = keyed([tuple(r) for r in bloom_lm.language_scores(rows, broadcast_bytes=0, segment_chars=20_000).collect()])
    assert routed == other


def test_a_segment_hears_from_a_slice_once_and_merging_keeps_the_bits(spark, scored):
    rows, _ = scored
    slices = bloom_lm.stage(bloom_lm.encode(rows.select("doc_id", "text", bloom_lm.in_test(F.col("doc_id")).alias("held_out")).repartition(5)), "t-slices")
    filters = bloom_lm.stage(bloom_lm.filter_segments(slices, 7), "t-filters")
    alone = bloom_lm.filter_segments(slices, 7, merged=1)
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, filters.collect()))
    told = bloom_lm.routed_levels(slices, filters, 7)
    pairs = told.select("slice", "segment").collect()
    assert len(pairs) == len(set(pairs)) <= 7 * slices.count()
    one_by_one = bloom_lm.routed_levels(slices, filters, 7, at_once=1)
    assert sorted(map(tuple, one_by_one.collect())) == sorted(map(tuple, told.collect()))


def test_remembered_levels_are_the_probed_ones(monkeypatch):
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 1 << 63, 30_000, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1))
    segment, residual = bloom_lm.split_hash(h, 3)
    count = rng.integers(1, 200, len(h))
    built = [bloom_lm.build_segment(residual[segment == k], count[segment == k]) for k in range(3)]
    made = bloom_lm.LogFrequencyFilter(np.asarray([len(x) for x in built]))
    for k, x in enumerate(built):
        made.put(k, x.tobytes())
    monkeypatch.setattr(bloom_lm, "REMEMBERED", 9_000)
    expected = made.levels(segment, residual)
    for part in (slice(None, 20_000), slice(10_000, None), slice(None), slice(0, 0)):
        assert (made.levels_again(h[part]) == expected[part]).all()
    assert 0 < len(made.known) <= 9_000 and (np.diff(made.known) > 0).all()
    monkeypatch.setattr(made, "levels", lambda of, asked: np.zeros(0) if not len(asked) else pytest.fail("probed again"))
    assert (made.levels_again(made.known) == made.known_levels).all()


def test_trigram_order(spark, scored):
    rows, found = scored
    higher = bloom_lm.language_scores(rows, order=3)
    again = bloom_lm.language_scores(rows, order=3, broadcast_bytes=0)
    got = keyed([tuple(r) for r in higher.collect()])
    assert keyed([tuple(r) for r in again.collect()]) == got and [r[:6] for r in got] == [r[:6] for r in found]


def test_filter_levels_and_false_positives():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 40_000, dtype=np.int64).view(np.uint64)
    count = np.minimum(rng.zipf(1.6, 40_000), 10**9)
    _, residual = bloom_lm.split_hash(h, 1)
    words = bloom_lm.build_segment(np.concatenate([residual, residual]), np.concatenate([count, count]))
    made = bloom_lm.LogFrequencyFilter(np.asarray([len(words)]))
    made.put(0, words.tobytes())
    level = made.levels(np.zeros(len(h), dtype=np.int64), residual)
    low, high = bloom_lm.LEAST[level], bloom_lm.MOST[level]
    assert (high >= 2 * count).all() and (low <= 2 * count).mean() > 0.98  # never too low; a false positive may raise it
    other = rng.integers(0, 1 << 63, 40_000, dtype=np.int64).view(np.uint64)
    assert (made.levels(np.zeros(len(h), dtype=np.int64), bloom_lm.split_hash(other, 1)[1]) > 0).mean() < 0.02
    assert (np.diff(bloom_lm.LEAST) > 0).all() and (bloom_lm.LEAST[1:12] == np.arange(1, 12)).all()


def test_probabilities_after_a_context_sum_to_at_most_one(spark):
    text = "a b a c a b d a b"
    frame = docs(spark, [(i, text, "en", "s", 0) for i in range(30)])
    vocabulary = ["a", "b", "c", "d"]
    probe = [(1000 + i, f"a {w}", "en", "s", 0) for i, w in enumerate([*vocabulary, "never"])]
    probe = [(next(k for k in range(d * 100, d * 100 + 100) if crc32(str(k).encode()) % 7 == 2), *r) for d, *r in probe]
    got = {r["doc_id"]: r["score"] for r in bloom_lm.language_scores(frame.unionByName(docs(spark, probe))).collect()}
    assert all(got[d] <= 0 for d, *_ in probe)
    start = math.log10(1.0)
    assert sum(10 ** (got[d] - start) for d, *_ in probe) < 1


def test_scores_of_odd_tables(spark, tmp_path):
    rows = docs(spark, AWKWARD * 2, clashing=True)
    got = keyed([tuple(r) for r in bloom_lm.language_scores(written(spark, rows, tmp_path)).collect()])
    assert [r[:5] for r in got] == [r[:5] for r in keyed(brute_scores(AWKWARD * 2))]
    assert bloom_lm.language_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    held = next(k for k in range(100) if crc32(str(k).encode()) % 7 == 2)
    alone = bloom_lm.language_scores(docs(spark, [(held, "only held out", "en", "s", 0)])).collect()
    assert [tuple(r) for r in alone] == [(held, True, 4, 0, 0, 0.0, 0.0)]
