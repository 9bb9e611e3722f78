"""A rewrite of shards that breaks off: before its files are whole, and while they are put in place."""

import os

import pytest

from ledgerloom.llm import reshard


def stored(spark, path):
    small = spark.createDataFrame([(i, f"text {i}" * (1 + i % 9)) for i in range(200)], "doc_id long, text string")
    plan = reshard.reshard(small, n_old=3, n_new=4)
    small.join(plan.select("doc_id", plan.old_shard.alias("shard"), "slot"), "doc_id").write.partitionBy("shard").parquet(path)
    docs = spark.read.parquet(path)
    return docs, reshard.reshard(docs.select("doc_id", "text", "shard"), n_new=4, old_shard="shard").cache()


def shards(spark, path):
    return {(r.doc_id, r.shard) for r in spark.read.parquet(path).collect()}


def test_files_are_written_beside_and_then_put_in_place(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    docs, plan = stored(spark, path)
    before, want = shards(spark, path), {(r.doc_id, r.shard) for r in plan.collect()}
    assert before != want

    def broken(*_):
        raise OSError("the driver was lost")

    finish = reshard.finish
    monkeypatch.setattr(reshard, "finish", broken)
    with pytest.raises(OSError, match="lost"):
        reshard.rewrite(docs, plan, path)
    assert shards(spark, path) == before  # nothing is in place yet
    with pytest.raises(RuntimeError, match="finish"):
        reshard.rewrite(docs, plan, path)
    finish(spark, path)
    assert shards(spark, path) == want
    finish(spark, path)
    assert shards(spark, path) == want and not [n for n in os.listdir(path) if n.startswith("_reshard")]


def test_a_rewrite_that_failed_while_writing_is_dropped(spark, tmp_path):
    path = str(tmp_path / "t")
    docs, plan = stored(spark, path)
    before = shards(spark, path)
    os.makedirs(f"{path}/_reshard-left/new/shard=0")
    reshard.finish(spark, path)
    assert shards(spark, path) == before and not os.path.exists(f"{path}/_reshard-left")
    reshard.rewrite(docs, plan, path)
    assert shards(spark, path) == {(r.doc_id, r.shard) for r in plan.collect()}
