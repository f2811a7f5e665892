"""The corpus pipeline against brute force for each stage on its own input, and on awkward tables."""

import importlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import AWKWARD, SF, docs, given, words, written
from tests.llm.test_native import _targets
from tests.llm.test_near_and_substring import _components


def _stages(spark, frame, tmp_path, sf_dir=SF):
    """[(name, input rows, output rows)] with every stage written and read again."""
    pipeline, out = importlib.import_module("corpus_pipeline"), []
    columns = frame.columns
    for k, (name, fn) in enumerate(pipeline.STAGES):
        result = fn(spark, frame, sf_dir)
        if k + 1 < len(pipeline.STAGES):
            assert result.columns == columns
        path = str(tmp_path / f"stage{k}")
        result.write.parquet(path)
        after = spark.read.schema(result.schema).parquet(path)
        out.append((name, frame.collect(), after.collect()))
        frame = after
    return out


@pytest.fixture(scope="module")
def given_stages(spark, tmp_path_factory):
    return _stages(spark, given(spark, "documents"), tmp_path_factory.mktemp("given"))


def test_every_stage_equals_brute_force(spark, given_stages):
    quality, exact, near, mixed, packed = given_stages

    from pacewise.llm.quality import judge

    verdict = {r.doc_id: r.kept for r in judge(given(spark, "documents")).collect()}
    assert {r.doc_id for r in quality[2]} == {i for i, kept in verdict.items() if kept}

    last = {}
    for r in exact[1]:
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact[2]) == sorted(last.values())

    _, label = _components([(r.doc_id, r.text) for r in near[1]])
    assert sorted(r.doc_id for r in near[2]) == sorted(set(label.values()))

    sizes, taken = Counter(), Counter()
    for r in mixed[1]:
        sizes[r.source] += len(words(r.text))
    targets = _targets(sizes)
    for r in mixed[2]:
        taken[r.source] += len(words(r.text))
    copies = Counter(r.doc_id for r in mixed[2])
    for r in mixed[1]:
        rate = targets[r.source] / max(sizes[r.source], 1)
        assert copies[r.doc_id] - int(rate) in (0, 1) and copies[r.doc_id] <= 2
    assert abs(sum(taken.values()) - sum(targets.values())) < 0.1 * sum(targets.values())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths, want = defaultdict(int), Counter()
    for r in mixed[2]:
        want[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    places = defaultdict(list)
    for r in packed[2]:
        lengths[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert lengths == want
    for own in places.values():
        assert sum(n for _, n in own) <= 2048 and min(o for o, _ in own) == 0
    assert len(places) <= -(-sum(lengths.values()) // 2048) + 1


def test_run_equals_its_stages(spark, given_stages):
    pipeline = importlib.import_module("corpus_pipeline")
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    staged = given_stages[-1][2]
    assert sorted(map(key, pipeline.run(spark, SF).collect())) == sorted(map(key, staged))
    assert pipeline.ORACLE_SQL is None


def test_awkward_and_empty_tables_go_through(spark, tmp_path):
    long = [(100 + k, f"{' '.join(f'word{k}x{j}' for j in range(80))}", "en", None, 1) for k in range(5)]
    for k, rows in enumerate((AWKWARD + long, [])):
        frame = written(spark, docs(spark, rows, clashing=True), tmp_path / f"in{k}")
        out = _stages(spark, frame, tmp_path / f"out{k}")
        assert out[0][1] == frame.collect() and (rows or not out[-1][2])




def test_stages_keep_every_text_when_the_splits_change_between_reads(spark, tmp_path):
    """An executor lost or added deals a scan out anew: row ids must not come from two scans."""
    from pacewise.llm import exact_dedup, quality, simhash_dedup
    from pacewise.session import scratch_path
    from tests.llm.fixtures import given

    given(spark, "documents").repartition(16).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    texts = {r["text"] for r in docs.select("text").collect()}
    keep = {"exact": lambda: exact_dedup.keep_one(docs, exact_dedup.DigestIndex(spark, scratch_path(spark, "splits-index")), "b"),
            "near": lambda: simhash_dedup.keep_one(docs, 0), "quality": lambda: quality.keep_good(docs)}
    found = {}
    for name, fn in keep.items():
        rows = {}
        for read in ("24", "1"):
            spark.conf.set("spark.sql.files.minPartitionNum", "24")
            try:
                out = fn()
                spark.conf.set("spark.sql.files.minPartitionNum", read)
                rows[read] = sorted(tuple(r) for r in out.select("doc_id", "text").collect())
            finally:
                spark.conf.unset("spark.sql.files.minPartitionNum")
        assert rows["24"] == rows["1"]
        found[name] = rows["1"]
    assert len(found["exact"]) == len(texts) and {t for _, t in found["exact"]} == texts
    assert len(found["near"]) <= len(texts) and len(found["quality"]) > 0


def test_a_stage_leaves_nothing_behind_once_the_next_has_begun(spark):
    import os

    import corpus_pipeline
    from pacewise.session import drop_scratch, scratch_given, scratch_since

    mark = scratch_given()
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 0
    left = [p for p in scratch_since(mark) if os.path.exists(p.removeprefix("file:"))]
    assert not [p for p in left if "numbered-rows" in p or "quality-rules" in p or "exact-dedup" in p]
    drop_scratch(spark, left)


def test_a_task_holds_a_bounded_part_of_whole_texts(spark):
    """Scans fill short vectors and written copies have small row groups, so the heap does not follow a file's size."""
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from pacewise.llm import common
    from pacewise.session import scratch_given, scratch_since

    text = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(j)), 256) for j in range(32)])  # 2 kB that do not compress to nothing
    docs, mark = spark.range(0, 24_000, numPartitions=1).select(F.col("id").alias("doc_id"), text.alias("text")), scratch_given()
    for name in (common.READ_ROWS, common.WRITE_BYTES):
        spark.conf.unset(name)
    assert common.numbered(docs).count() == 24_000
    assert int(spark.conf.get(common.READ_ROWS)) <= common.VECTOR_ROWS
    files = glob.glob(f"{scratch_since(mark)[0].removeprefix('file:')}/*.parquet")
    groups = [pq.ParquetFile(f).metadata.row_group(g).total_byte_size for f in files for g in range(pq.ParquetFile(f).num_row_groups)]
    assert sum(groups) > 40 << 20 and max(groups) <= 1.5 * common.ROW_GROUP_BYTES
    spark.conf.set(common.READ_ROWS, "64")  # a smaller setting is kept
    common.text_session(docs)
    assert spark.conf.get(common.READ_ROWS) == "64"
    for name in (common.READ_ROWS, common.WRITE_BYTES):
        spark.conf.unset(name)
