"""Global ranks, percentiles and crossings against plain programs, over many partitions."""

import contextlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ranks
from ledgerloom.sources import scratch


@contextlib.contextmanager
def many(spark, n=13):
    """Range partitions that adaptive execution leaves apart."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module")
def rows():
    """A third of all values are one value; some are null."""
    rng = np.random.default_rng(4)
    return [(i, None if i % 29 == 0 else 7.0 if i % 3 == 0 else float(np.round(rng.normal(), 2)), int(rng.integers(0, 5)), float(rng.exponential())) for i in rng.permutation(2000).tolist()]


def test_three_ranks_in_one_pass(spark, rows):
    df = spark.createDataFrame(rows, "id long, a double, b long, c double").withColumn("other", F.lit("x")).repartition(5)
    with many(spark):
        got = ranks.ranked(df, {"ra": "a", "rb": "b", "rc": "c"}, "id")
        assert got.columns == ["id", "a", "b", "c", "other", "ra", "rb", "rc", "n"]
        got = {r["id"]: r for r in got.collect()}
        one = {r["id"]: r["ra"] for r in ranks.ranked(df, {"ra": "a"}, "id").collect()}
    assert len(got) == 2000 and all(r["n"] == 2000 and r["other"] == "x" for r in got.values())
    for k, name in ((1, "ra"), (2, "rb"), (3, "rc")):
        order = sorted(rows, key=lambda r: (r[k] is not None, r[k] or 0, r[0]))
        assert all(got[r[0]][name] == i for i, r in enumerate(order, 1))
    assert all(got[i]["ra"] == r for i, r in one.items())


def test_a_frequent_value_lies_over_many_partitions(spark, rows):
    df = spark.createDataFrame(rows, "id long, a double, b long, c double")
    with many(spark):
        sizes = [r["count"] for r in ranks._dealt(df.select("id", "a"), "a", "id").groupBy("_part").count().collect()]
    assert max(sizes) < 2000 / 8


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 2000])
def test_percentiles(spark, rows, n):
    df = spark.createDataFrame(rows[:n], "id long, a double, b long, c double")
    with many(spark):
        got = ranks.percentiles(df, [F.col("a"), F.col("b"), F.col("c"), F.lit(None)], [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    for k in range(3):
        seen = [r[k + 1] for r in rows[:n] if r[k + 1] is not None]
        assert got[f"n{k}"] == len(seen)
        assert got[f"q{k}"] is None if not seen else np.allclose(got[f"q{k}"], np.quantile(seen, [0.0, 0.25, 0.5, 0.9, 1.0]), rtol=1e-12)
    assert got["q3"] is None and got["n3"] == 0


@pytest.mark.parametrize("share", [0.0, 0.3, 0.8, 1.0])
def test_reaching(spark, rows, share):
    made = [(i, -c, Decimal(repr(round(c, 6)))) for i, _, _, c in rows]
    df = spark.createDataFrame(made, "id long, by double, v decimal(18,6)")
    with many(spark):
        got = ranks.reaching(df, "by", "id", "v", share).first()
    order = sorted(made, key=lambda r: (r[1], r[0]))
    total, upto, want = sum(r[2] for r in made), Decimal(0), None
    for i, r in enumerate(order, 1):
        upto += r[2]
        if want is None and float(upto) / float(total) >= share:
            want = i
    assert (got["reach"], got["n"], got["all"]) == (want, 2000, total)
    none = ranks.reaching(df.limit(0), "by", "id", "v", share).first()
    assert none["reach"] is None and none["n"] == 0


def test_scratch_tables_go(spark):
    df = scratch.hold(spark.range(5), "some")
    assert df.count() == 5
    path = scratch._MADE[-1][1]
    fs, where = scratch.filesystem(spark, path)
    assert fs.exists(where)
    scratch.clear()
    assert not fs.exists(where) and not scratch._MADE
