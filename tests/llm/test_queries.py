"""Every registered query against its SQL, or its invariants; the registry itself."""

import re

import pytest

from pacewise.llm.queries import ORACLE, QUERIES
from tests.conftest import SF0001
from tests.oracle_harness import compare

COLUMNS = {
    1: ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], 2: ["doc_id", "fingerprint", "component_id"],
    3: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    4: ["doc_id", "held_out", "score", "predicted"],
    5: ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    6: ["doc_id", "n_before", "n_tokens", "n_edits", "recounted_chars"],
    7: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], 8: ["doc_id", "n_words", "n_removed", "kept_sha256"],
    9: ["doc_id", "size", "source_size", "target", "taken"],
    10: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    11: ["lang", "rank", "phrase", "a", "l", "r", "n", "score"], 12: ["word", "form", "root", "n", "n_near", "form_n"],
    13: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    res = compare(QUERIES[name](spark, SF0001), ORACLE[name], duck)
    assert res["columns_match"] and res["match"], res


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_covers_the_whole_table(spark, name):
    n = int(re.match(r"op(\d+)_", name)[1])
    df = QUERIES[name](spark, SF0001)
    assert set(COLUMNS[n]) <= set(df.columns)
    rows = df.collect()
    if "word" in COLUMNS[n]:  # a row per word of the vocabulary
        assert rows and len({r["word"] for r in rows}) == len(rows)
        return
    assert {r["doc_id"] for r in rows} == set(range(200))
    assert len(rows) == 200 or n == 5
