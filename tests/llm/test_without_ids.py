"""Half of all rows have a null id and one text: work is spread, results stay whole."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mixing, packing, reshard
from ledgerloom.llm.common import doc_hash, place_of_null, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
N = 3000


@pytest.fixture(scope="module")
def halves(spark):
    rows = [(None, "one text that many rows share", "xx", "s0", 29) for _ in range(N)]
    rows += [(i, f"text {i} " + "word " * (i % 9), "xx", f"s{i % 3}", 9) for i in range(N)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


@pytest.mark.parametrize("seed", [packing.SEED, packing.SEED + 1, reshard.SEED, reshard.SEED + 1])
def test_places_spread_rows(halves, seed):
    table = written(halves.withColumn("place", place_of_null("doc_id")), "places")
    parts = table.groupBy(F.pmod(doc_hash("doc_id", "place", seed=seed), F.lit(64))).count().collect()
    assert max(r[1] for r in parts) < 2 * N / 8
    # Rows with an id lie where they would without the column.
    moved = table.where("doc_id is not null").where(doc_hash("doc_id", "place", seed=seed) != doc_hash("doc_id", seed=seed))
    assert moved.count() == 0


def test_resharding(halves):
    rows = reshard.reshard(halves).collect()
    assert len(rows) == 2 * N
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(sizes) == 16 and max(sizes.values()) < 1.1 * min(sizes.values())


def test_packing(halves):
    rows = packing.pack(halves).collect()
    assert Counter(r["doc_id"] for r in rows)[None] == N
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(held) == list(range(len(held)))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW


def test_mixing(halves):
    rows = mixing.source_mix(halves).collect()
    assert len(rows) == 2 * N
    taken, target, size = Counter(), {}, {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 12


@pytest.mark.parametrize("wanted", [0, 1, 700, 1999, 2000, 2500])
def test_ties_are_numbered_in_parts(spark, wanted):
    ties = spark.createDataFrame([("a", 7, 5, 1, wanted, i) for i in range(2000)] + [("b", 7, 5, 0, 3, i) for i in range(5)], "pattern string, _hash long, size long, copies int, _ties int, doc_id long").repartition(4)
    out = mixing._tied(ties)
    got = {r[0]: (r[1], r[2]) for r in out.groupBy("pattern").agg(F.sum("copies"), F.count("*")).collect()}
    assert got == {"a": (2000 + min(wanted, 2000), 2000), "b": (3, 5)}
    assert out.groupBy("pattern", "_part").count().agg(F.max("count")).first()[0] < 2000 / 8
