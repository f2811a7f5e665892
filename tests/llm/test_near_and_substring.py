"""SimHash near-dedup and substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from pacewise.llm import components, simhash_dedup, substring_dedup
from tests.llm.fixtures import AWKWARD, docs, given, words, written


def _fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(rows):
    """{doc_id: smallest doc_id reachable} by comparing all fingerprints with all."""
    fps = {i: _fingerprint(t) for i, t in rows}
    label = {i: i for i in fps}
    ids = list(fps)
    bits = np.array([fps[i] for i in ids], dtype=np.uint64)
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            near = [ids[j] for j in np.flatnonzero(np.bitwise_count(bits ^ bits[k]) <= 3)]
            low = min(label[j] for j in near)
            if low < label[i]:
                label[i], changed = low, True
    return fps, label


def _near_copies(n, seed=3):
    """Groups of long texts that differ in a word, and single texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = []
    for g in range(n):
        base = rng.choices(vocabulary, k=400)
        for _ in range(rng.choice([1, 1, 3, 8])):
            copy = list(base)
            copy[rng.randrange(400)] = "changed"
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
    return rows


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows_near(spark, tmp_path, clashing):
    frame = written(spark, docs(spark, clashing=clashing), tmp_path)
    rows = simhash_dedup.near_components(frame).collect()
    assert len(rows) == len(AWKWARD)
    fps, label = _components([(i, t) for i, t, *_ in AWKWARD if i is not None])
    for r in rows:
        if r.doc_id is not None:
            assert r.fp & (2**64 - 1) == fps[r.doc_id] and r.component_id == label[r.doc_id]
    assert {r.component_id for r in rows if r.doc_id is None and r.fp == 0} == {1}
    left = simhash_dedup.keep_one(frame)
    assert left.columns == frame.columns
    assert left.count() == len({r.root for r in rows})


def test_near_copies_equal_brute_force(spark):
    rows = _near_copies(60)
    got = simhash_dedup.near_components(docs(spark, rows)).collect()
    fps, label = _components([(r[0], r[1]) for r in rows])
    assert {r.doc_id: r.component_id for r in got} == label
    assert len(set(label.values())) < len(set(fps.values())) <= len(rows)  # different fingerprints are linked


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_every_allocation_finds_all_links(spark, m):
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for flips in range(5):
            fps.add(int(b) ^ sum(1 << int(k) for k in rng.choice(64, flips, replace=False)))
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    table = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    n, both = simhash_dedup.bit_counts(table)
    assert n == len(fps)
    groups = simhash_dedup.correlated_groups(n, both, m)
    assert sorted(b for g in groups for b in g) == list(range(64))
    if m == 1:  # one partition must take the whole radius: check the plan only, its probes are too many for a test
        assert simhash_dedup.allocate(groups, [[1.0] * 4], n, 3)[1][0].threshold == 3
        return
    equal = simhash_dedup.equal_pairs(table, [simhash_dedup.mask_of(g) for g in groups])
    estimates = [simhash_dedup.candidate_estimates(n, np.diag(both) / n, g, e, 3) for g, e in zip(groups, equal)]
    plan = simhash_dedup.allocate(groups, estimates, n, 3)[1]
    assert sum(p.threshold + 1 for p in plan) == 4
    got = {(r.a, r.b) for r in simhash_dedup.near_links(table, plan).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want


def test_thresholds_may_differ():
    # The first partition is far more selective than the others: it gets more of the radius.
    estimates = [[1.0, 2.0, 3.0, 4.0], [1e9] * 4, [1e9] * 4]
    plan = simhash_dedup.allocate([[0, 1, 2], [3, 4, 5], [6, 7, 8]], estimates, 10, 3)[1]
    assert [(p.bits[0], p.threshold) for p in plan] == [(0, 3)]


def test_components_of_a_path_a_star_and_pairs(spark):
    path = [(k, k + 1) for k in range(60)]
    star = [(1_000, 1_000 + k) for k in range(1, 40)]
    pairs = [(5_001, 5_000), (-7, 9_000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path + star + pairs, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1_000 + k: 1_000 for k in range(40)}, 5_000: 5_000, 5_001: 5_000, -7: -7, 9_000: -7}


def test_near_of_an_empty_table(spark):
    assert simhash_dedup.near_components(docs(spark, [])).collect() == []


# -- 8 substring dedup -------------------------------------------------------------------


def _kept(rows, k=13):
    w = {}
    for i, t in rows:
        w[i] = words(t)
    first = {}
    for i in sorted(w):
        for a in range(len(w[i]) - k + 1):
            first.setdefault(tuple(w[i][a:a + k]), i)
    out = {}
    for i, mine in w.items():
        gone = {a + j for a in range(len(mine) - k + 1) if first[tuple(mine[a:a + k])] < i for j in range(k)}
        out[i] = (len(mine), len(gone), " ".join(x for j, x in enumerate(mine) if j not in gone))
    return out


def _shared_passages(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(40)] + ["é", "日本"]
    passages = [rng.choices(vocabulary, k=n) for n in (13, 14, 30, 60, 12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += rng.choices(vocabulary, k=rng.randrange(30)) + rng.choice(passages)
        rows.append((i, (rng.choice([" ", "\n", " \t "])).join(parts), "en", "s", 0))
    return rows


def test_shared_passages_both_ways(spark, monkeypatch):
    rows = _shared_passages()
    want = _kept([(r[0], r[1]) for r in rows])
    assert any(x[1] for x in want.values())
    for heavy in (substring_dedup.HEAVY_ROWS, 2, 0):
        monkeypatch.setattr(substring_dedup, "HEAVY_ROWS", heavy)
        got = substring_dedup.remove_repeats(docs(spark, rows)).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == want


@pytest.mark.parametrize("clashing", [False, True])
def test_awkward_rows_substring(spark, clashing):
    got = substring_dedup.remove_repeats(docs(spark, clashing=clashing)).collect()
    assert len(got) == len(AWKWARD)
    want = _kept([(i, t) for i, t, *_ in AWKWARD if i is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert want[5][2] == "" and want[6][2] == "again" and want[4][1] == 0


def test_hash_collisions_are_sorted_out_by_the_words(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(substring_dedup, "mix64", lambda x: x & np.uint64(1))
    texts = [" ".join(f"{c}{k % 3}" for k in range(20)) for c in "abab"]
    doc = np.arange(4)
    got = substring_dedup.repeated_ranges(doc, np.zeros(4, dtype=np.int64), pa.array(texts, pa.large_string())).to_pydict()
    covered = {d: set() for d in range(4)}
    for d, a, b in zip(got["doc_id"], got["start"], got["stop"]):
        covered[d] |= set(range(a, b))
    assert [len(covered[d]) for d in range(4)] == [0, 0, 20, 20]


def test_substring_of_given_documents(spark):
    frame = given(spark, "documents")
    want = _kept([(r.doc_id, r.text) for r in frame.collect()])
    got = substring_dedup.remove_repeats(frame).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == {
        i: (n, m, hashlib.sha256(t.encode()).hexdigest()) for i, (n, m, t) in want.items()}


def test_substring_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(docs(spark, [])).collect() == []




def test_rows_of_one_doc_id_with_different_texts_are_judged_each_by_its_own(spark):
    """As documents of their own, neither of which is the smaller one."""
    from pacewise.llm import substring_dedup
    from tests.llm.fixtures import docs

    text = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    first, other, alone = text("a", 60), text("b", 40), text("c", 200)
    rows = [(1, first, "en", "s", 0), (2, alone, "en", "s", 0), (2, text("d", 3), "en", "s", 0), (2, first + " tail", "en", "s", 0),
            (2, first + " tail", "en", "s", 0), (3, other, "en", "s", 0), (3, other + " more", "en", "s", 0), (4, other, "en", "s", 0)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(docs(spark, rows)).collect())
    # Equal windows of doc_id 3 lie in one document of that id each: none is smaller, so both stay; document 4 loses all.
    assert got == sorted([(1, 60, 0), (2, 200, 0), (2, 3, 0), (2, 61, 60), (2, 61, 60), (3, 40, 0), (3, 41, 0), (4, 40, 40)])
