import os
from hashlib import sha256

import corpus_pipeline
from tidemark.llm.common import materialise, release, shared_dir
from tidemark.llm.registry import ORACLES, QUERIES


def test_stages_in_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf), f"test-{name}")
        kept[name] = docs
        if name != "encode":
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "encode"]
    texts = [r.text for r in kept["exact"].collect()]
    assert len(texts) == len(set(texts)) == kept["quality"].select("text").distinct().count()
    assert kept["mix"].groupBy("doc_id").count().where("count > 2").count() == 0
    assert kept["encode"].count() == kept["mix"].count()
    assert kept["encode"].where("ids_sha256 IS NULL OR n_tokens <= 0").count() == 0


def test_run_gives_the_stages_rows(spark, sf):
    once, again = (sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()) for _ in range(2))
    assert once == again and once


def test_nothing_is_left_in_the_shared_folder(spark, sf):
    release()
    corpus_pipeline.run(spark, sf).count()
    at = shared_dir(spark).removeprefix("file:").replace("//", "/")
    assert sum(x.startswith("tidemark-pipeline") for x in os.listdir(at)) == 1  # what the last stage reads
    release()
    assert [x for x in os.listdir(at) if x.startswith("tidemark-")] == []


def test_empty_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_awkward_rows_through_every_stage(spark, frame, awkward, tmp_path):
    """Null ids and texts, empty, blank and very long texts, repeated rows, columns whose names the operators use inside."""
    sf = str(tmp_path)
    frame(awkward).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")  # nothing to learn from: all stay
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), f"test-{name}")
        assert name == "encode" or docs.columns == columns
        kept[name] = sorted((r.doc_id for r in docs.collect()), key=str)
    assert kept["quality"] == sorted((r[0] for r in awkward), key=str)
    assert kept["exact"] == sorted([2, 4, 5, 6, 7, 8, 9, 10, None, 11, 12], key=str)  # the largest id of equal texts; null is empty
    assert kept["near"] == sorted([2, 4, 6, 9, 10, None, 11], key=str)
    assert set(kept["mix"]) <= set(kept["near"]) and max(map(kept["mix"].count, kept["mix"])) <= 2
    texts = {(t or "").encode() for _, t in (r[:2] for r in awkward)}
    assert {r.decoded_sha256 for r in docs.collect()} <= {sha256(t).hexdigest() for t in texts}
    assert sorted((r.doc_id for r in corpus_pipeline.run(spark, sf).collect()), key=str) == kept["encode"]
