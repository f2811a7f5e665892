"""Packing and edit-aware counts against the tokenizers themselves."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pacewise.llm import packing, token_counts
from pacewise.llm.word_ids import TextIds
from tests.llm.fixtures import AWKWARD, docs, given

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " \n", "Ünïcode ÀÉ İstanbul ΣΑΣ.", "á b ́c", "x<|endoftext|>y <|startoftext|>", "don't we'LL 12abc34 ²³ ½ a\xa0b c \x1c\x1f d\x85e",
       "日本語テキスト 🙂🙂", "é́ ñ ÿ Ÿ ß ẞ µ ª º × ÷", "''s's 'tt", "\x00 a\x00b", "A" * 5_000, "!?" * 999]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORD_BPE)


@pytest.mark.parametrize("remembered", [3, 500_000])
def test_word_ids_equal_the_tokenizer(spark, tokenizer, remembered):
    texts = ODD + [r.text for r in given(spark, "documents").select("text").collect()]
    got = TextIds(WORD_BPE, remembered).texts(pa.array([*texts, None]))
    for text, ids in zip([*texts, ""], got, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_places_of_awkward_rows(spark, tokenizer):
    rows = packing.pack(docs(spark, clashing=True), WORD_BPE).collect()
    want = []
    for i, t, *_ in AWKWARD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k, s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    _check_places(rows)


def _check_places(rows, capacity=2048):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_given_documents_are_packed_to_the_bound(spark):
    rows = packing.pack(given(spark, "documents"), WORD_BPE).collect()
    assert _check_places(rows) <= -(-sum(r.length for r in rows) // 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_rank_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 60): rng.randint(1, 50) for _ in range(rng.randint(1, 25))}
    plan = packing.packing_plan(counts, 60)
    ends = [(plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == plan[k][0] else counts[plan[k][0]]) for k in range(len(plan))]
    sequences = defaultdict(list)
    for (length, first, sequence, offset), end in zip(plan.tolist(), ends, strict=True):
        for rank in range(first, end):
            sequences[sequence + rank - first].append((offset, length))
    assert sorted(x for s in sequences.values() for _, x in s) == sorted(x for x, n in counts.items() for _ in range(n))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 60
    best_fit = _best_fit_decreasing(counts, 60)
    assert -(-sum(x * n for x, n in counts.items()) // 60) <= len(sequences) <= best_fit + 1


def _best_fit_decreasing(counts, capacity):
    gaps = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(capacity - x)
        else:
            gaps[gaps.index(fit)] -= x
    return len(gaps)


@pytest.mark.parametrize(("counts", "want"), [
    ({70: 5, 30: 5}, [[30, 70]] * 5), ({55: 2, 30: 2, 15: 2}, [[15, 30, 55]] * 2), ({40: 1, 30: 1, 20: 1, 10: 1}, [[10, 20, 30, 40]]),
    ({25: 8}, [[25] * 4] * 2), ({60: 2, 20: 4}, [[20, 20, 60]] * 2),
])
def test_exact_complements_are_found(counts, want):
    plan = packing.packing_plan(counts, 100)
    ends = [(plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == plan[k][0] else counts[plan[k][0]]) for k in range(len(plan))]
    sequences = defaultdict(list)
    for (length, first, sequence, _), end in zip(plan.tolist(), ends, strict=True):
        for rank in range(first, end):
            sequences[sequence + rank - first].append(length)
    assert sorted(sorted(s) for s in sequences.values()) == sorted(want)


def test_pack_of_an_empty_table(spark):
    assert packing.pack(docs(spark, []), WORD_BPE).collect() == []


# -- 6 edit-aware counts --------------------------------------------------------------------

ALPHABET = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "1", "23", "é", "word", "The", "!!", "\t", "日", "🙂", ". "]


@pytest.mark.parametrize("leaf", [1, 4, 64])
def test_counts_after_random_edits_equal_counting_anew(monkeypatch, leaf):
    monkeypatch.setattr(token_counts, "LEAF", leaf)
    by, rng = token_counts.counter(BYTE_BPE), random.Random(leaf)
    for _ in range(120):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        tree = token_counts.TokenTree.build(text, by)
        for _ in range(10):
            at, removed = rng.randint(-1, len(text) + 2), rng.choice([0, 0, 1, 2, 5, 50])
            inserted = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 6, 60])))
            place = max(0, min(at, len(text)))
            want = text[:place] + inserted + text[place + removed:]
            tree, text, _ = tree.edit(text, at, removed, inserted, by)
            assert text == want and tree.chars[1] == len(text)
            assert tree.total == len(by.encoding.encode_ordinary(text))
            for sums in (tree.chars, tree.tokens):
                assert all(sums[k] == sums[2 * k] + sums[2 * k + 1] for k in range(1, tree.size))


def test_an_edit_of_a_long_text_encodes_little_again():
    by = token_counts.counter(BYTE_BPE)
    text = "some words of a long text, " * 4_000
    tree = token_counts.TokenTree.build(text, by)
    for at in (0, 50_000, len(text)):
        tree, text, again = tree.edit(text, at, 3, "new words", by)
        assert again < 1_500
    assert tree.total == len(by.encoding.encode_ordinary(text))


def test_awkward_rows_and_an_edit_log(spark):
    by = token_counts.counter(BYTE_BPE)
    state = token_counts.build_trees(docs(spark, clashing=False).drop("lang", "source", "n_chars"), BYTE_BPE)
    log = spark.createDataFrame([(4, 2, 0, 3, "A"), (4, 1, 10, 0, " x\n\n y"), (1, 1, 5, 5, "grown"), (2, 1, None, None, None), (8, 1, 1, 4, "🙂"),
                                 (99, 1, 0, 0, "nobody"), (7, 1, 90_000, 7, "middle")], "doc_id bigint, seq int, at bigint, removed bigint, inserted string")
    got = token_counts.apply_edits(token_counts.attach_edits(state, log), BYTE_BPE).collect()
    assert len(got) == len(AWKWARD)
    texts = {i: t or "" for i, t, *_ in AWKWARD}
    for i, _, at, removed, inserted in sorted([(4, 1, 10, 0, " x\n\n y"), (4, 2, 0, 3, "A"), (1, 1, 5, 5, "grown"), (8, 1, 1, 4, "🙂"), (7, 1, 90_000, 7, "middle")]):
        at = min(at, len(texts[i]))
        texts[i] = texts[i][:at] + inserted + texts[i][at + removed:]
    for r in got:
        if r.doc_id is not None:
            assert r.text == texts[r.doc_id] and r.n_tokens == len(by.encoding.encode_ordinary(r.text))
    assert {r.n_edits for r in got if r.doc_id == 4} == {2} and {r.recounted_chars for r in got if r.doc_id == 5} == {0}
    again = token_counts.apply_edits(token_counts.attach_edits(spark.createDataFrame(got).select("doc_id", "text", "chars", "tokens"), log), BYTE_BPE)
    assert all(r.n_tokens == len(by.encoding.encode_ordinary(r.text)) for r in again.collect())  # trees of trees


def test_counts_of_an_empty_table(spark):
    state = token_counts.build_trees(docs(spark, []).select("doc_id", "text"), BYTE_BPE)
    log = spark.createDataFrame([], "doc_id bigint, seq int, at bigint, removed bigint, inserted string")
    assert token_counts.apply_edits(token_counts.attach_edits(state, log), BYTE_BPE).collect() == []


def test_columns_of_the_same_names_stay(spark):
    """Columns named as the state's or the log's do not disturb the trees or the edits."""
    rows = [(1, "one two three", "c", "t", "l", "e"), (2, None, "c2", "t2", "l2", "e2")]
    state = token_counts.build_trees(spark.createDataFrame(rows, "doc_id long, text string, chars string, tokens string, log string, edits string"), BYTE_BPE)
    log = spark.createDataFrame([(1, 0, 0, 3, "four")], "doc_id long, seq long, at long, removed long, inserted string")
    ready = token_counts.attach_edits(state, log)
    assert {(r.doc_id, r.given_chars, r.given_tokens, r.log) for r in ready.collect()} == {(1, "c", "t", "l"), (2, "c2", "t2", "l2")}
    got = {r.doc_id: r for r in token_counts.apply_edits(ready, BYTE_BPE).collect()}
    assert got[1].text == "four two three" and got[1].n_edits == 1 and got[2].text == "" and got[2].n_edits == 0
