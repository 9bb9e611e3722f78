"""The pipeline's stages, each on what the one before kept."""

import glob
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import common, registry


def test_stages(spark, rows, docs, none, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    now, seen = docs.select(*columns), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(now)
        if k < 4:
            assert now.columns == columns
    text = {i: t for i, t, *_ in rows}
    kept = [{r.doc_id for r in x.select("doc_id").distinct().collect()} for x in seen]
    assert kept[0] >= {i for i, t in text.items() if t and len(t) > 60 and t.isascii()}
    assert not kept[0] & {i for i, t in text.items() if not (t or "").strip()}
    assert kept[1] == {max(j for j in kept[0] if text[j] == text[i]) for i in kept[0]}
    assert kept[2] <= kept[1] and len(kept[2]) < len(kept[1])
    assert kept[3] <= kept[2]
    assert kept[4] == kept[3]


def test_empty(spark, none, tmp_path):
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0


def test_registry():
    names = set(registry.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert all(f.__doc__ for n, f in registry.queries().items())
    assert set(registry.oracle_sql()) <= names


def test_run(spark, docs, tmp_path):
    """The whole pipeline over a folder: null ids, repeated rows and columns with clashing names; it gives what its stages give, and leaves no stage's table but the last."""
    some = docs.where("doc_id < 200")
    odd = some.unionAll(some.where("doc_id < 40")).unionAll(some.where("doc_id < 20").withColumn("doc_id", F.lit(None).cast("long")))
    odd.coalesce(3).write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    before = set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/stage-*"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(glob.glob(common.shared_dir(spark).removeprefix("file://") + "/stage-*")) - before
    assert [x.split("/")[-1].rsplit("-", 1)[0] for x in left] == ["stage-source_mixing"]
    got = Counter(tuple(r) for r in out.select(*columns).collect())
    assert got == Counter(tuple(r) for r in now.select(*columns).collect()) and got
