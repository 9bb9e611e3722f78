"""Sinks, samples and operators whose work is cut so that no key is one task."""

import random
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.series import register_forecasts
from ledgerloom.operators import basket, cleaning, forecast, pricing, returning
from ledgerloom.plans import catalog
from ledgerloom.sources import csvfile, lines
from ledgerloom.sources.adapter import raw_lines

SF = "/root/testdata/sf0.001"


# ---- named files -------------------------------------------------------------


def test_csv_file(spark, tmp_path):
    path = str(tmp_path / "new" / "report.csv")
    df = spark.range(200).select("id", (F.col("id") / 3).alias("x"), F.when(F.col("id") % 2 == 0, F.concat(F.lit('a "b", '), F.col("id"))).alias("s"), F.lit(True).alias("b"), F.expr("timestamp'2011-01-01 09:30:00'").alias("t"), F.expr("CAST(1.50 AS DECIMAL(5,2))").alias("d"))
    csvfile.write_csv(df.repartition(7), path, "id")
    one = open(path, "rb").read()
    csvfile.write_csv(df.repartition(3), f"file://{path}", "id")
    assert open(path, "rb").read() == one
    text = one.decode().splitlines()
    assert text[0] == "id,x,s,b,t,d" and len(text) == 201
    assert text[1] == '0,0.0,"a ""b"", 0",True,2011-01-01 09:30:00,1.50' and text[2].startswith("1,0.3333333333333333,,True")
    assert [p.name for p in (tmp_path / "new").iterdir()] == ["report.csv"]
    csvfile.write_csv(df.limit(0), path)
    assert open(path).read() == "id,x,s,b,t,d\n"


def test_a_failed_task_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "report.csv")
    csvfile.write_csv(spark.range(5), path, "id")
    before = open(path, "rb").read()
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        csvfile.write_csv(broken, path)
    assert open(path, "rb").read() == before and [p.name for p in tmp_path.iterdir()] == ["report.csv"]
    with pytest.raises(Exception, match="exists"):
        spark.range(5).write.format("csvfile").mode("append").save(path)


# ---- samples -------------------------------------------------------------------


def test_fixture_has_exact_strata_and_whole_groups(spark):
    raw = raw_lines(spark, SF).select(*cleaning.KEY)
    got = lines.fixture(raw, 0.1)
    n = {"all": 160, "cancelled": 15, "other": 10, "zero": 6}
    rows = got.collect()
    groups = Counter(map(tuple, raw.collect()))
    drawn = Counter(map(tuple, rows))
    # Two groups of copies come with every copy, over and above the strata.
    extra = len(rows) - sum(n.values())
    assert extra >= 4
    whole = [g for g in drawn if groups[g] > 1 and drawn[g] >= groups[g]]
    assert len(whole) >= 2
    again = lines.fixture(raw.repartition(7), 0.1)
    assert Counter(map(tuple, again.collect())) == drawn
    strata = {"c": (cleaning.is_cancellation(F.col("Invoice")), 15), "few": (F.col("Price") == -1, 9), "p": (F.col("Price") <= 0, 6)}
    got = lines.sample_strata(raw, strata).collect()
    assert len(got) == 21 and sum(r["Invoice"].startswith("C") for r in got) >= 15
    only = lines.sample_strata(raw, {}, (list(cleaning.KEY), 3))
    found = Counter(map(tuple, only.collect()))
    assert len(found) == 3 and all(groups[g] == k > 1 for g, k in found.items())
    assert lines.sample_strata(raw, {}).count() == 0


# ---- as-of match -----------------------------------------------------------------


def trades(spark, seed, pairs, n=400):
    """Sales and returns over two years, ties in time and months without any; one pair is most of them."""
    rng = random.Random(seed)
    start = datetime(2010, 1, 1)
    rows = []
    for i in range(n):
        who, code = (1, "A") if i % 2 else rng.choice(pairs)
        when = start + timedelta(hours=rng.choice([rng.randint(0, 17_000), 24 * rng.randint(0, 700)]))
        back = rng.random() < 0.4
        rows.append((f"{'C' if back else ''}{i}", code, "x", -1 if back else 1, when, 2.0, who, "UK"))
    return cleaning.clean(spark.createDataFrame(rows, "Invoice string, StockCode string, Description string, Quantity long, InvoiceDate timestamp, Price double, CustomerID long, Country string"))


@pytest.mark.parametrize("part", ["MONTH", "DAY", "YEAR"])
def test_match_in_slices(spark, part):
    c = trades(spark, 3, [(1, "B"), (2, "A"), (3, "C"), (None, "A")])
    sales = [(r["CustomerID"], r["StockCode"], r["InvoiceDate"]) for r in c.sales.collect()]
    want = Counter()
    for r in c.returns.where("CustomerID IS NOT NULL").collect():
        past = [t for who, code, t in sales if (who, code) == (r["CustomerID"], r["StockCode"]) and t <= r["InvoiceDate"]]
        want[r["Invoice"], max(past, default=None)] += 1
    got = returning.match_to_sales(c.sales, c.returns, part)
    assert Counter((r["Invoice"], r["SaleDate"]) for r in got.collect()) == want


def test_one_pair_is_many_tasks(spark):
    """A pair with nearly all lines: no window task has over a sixteenth of them."""
    c = trades(spark, 4, [(1, "A")], 3000)
    key = ["CustomerID", "StockCode", F.date_trunc("MONTH", "InvoiceDate")]
    rows = c.sales.select("CustomerID", "StockCode", "InvoiceDate").unionAll(c.returns.select("CustomerID", "StockCode", "InvoiceDate"))
    assert max(r["count"] for r in rows.groupBy(*key).count().collect()) <= rows.count() / 16
    plan = returning.match_to_sales(c.sales, c.returns)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [last(" in line]
    assert windows and all("slice#" in w.split("], [")[1] for w in windows)
    # The join takes the windows' partitions as they are: of its sides, only the slices move again.
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning(CustomerID#") <= 5


# ---- baskets ---------------------------------------------------------------------


@pytest.mark.parametrize("block", [32_768, None])
def test_itemsets_by_bitmaps(spark, block):
    rng = random.Random(6)
    items = [f"I{i:02}" for i in range(12)]
    held = {f"B{i}": sorted(rng.sample(items, rng.randint(2, 7)) + (["I00", "I01"] if i % 3 == 0 else [])) for i in range(300)}
    rows = [(b, x) for b, s in held.items() for x in set(s)]
    pairs = spark.createDataFrame(rows, "Invoice string, Item string").repartition(5)
    config = basket.BasketConfig(min_support=0.1)
    if block is None:  # baskets over many blocks
        spread = basket.vertical

        def wide(p):
            out = spread(p)
            bits = F.col("bits")
            halves = [(0, 20), (20, 4096)]
            return out.select(F.explode(F.array(*[F.struct((F.col("block") * 2 + k).alias("block"), F.col("Item").alias("Item"), F.concat(F.lit(bytes(a)), F.substring(bits, a + 1, b - a), F.lit(bytes(4096 - b))).alias("bits")) for k, (a, b) in enumerate(halves)])).alias("x")).select("x.*")

        basket.vertical = wide
    try:
        sets, n = basket.itemsets(pairs, config)
    finally:
        if block is None:
            basket.vertical = spread
    least = basket.min_count(0.1, 300)
    want = {}
    for size in (1, 2, 3):
        for c in combinations(items, size):
            k = sum(set(c) <= set(s) for s in held.values())
            if k >= least:
                want[c] = k
    got = {tuple(x for x in (r["a"], r["b"], r["c"]) if x): r["count"] for r in sets.collect()}
    assert n == 300 and got == want and any(len(c) == 3 for c in want)
    none, n = basket.itemsets(pairs.limit(0), config)
    assert none.count() == 0 and n == 0


def test_no_basket_meets_itself(spark):
    pairs = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "Invoice string, Item string")
    plan = basket.vertical(pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 2  # numbers of baskets: offsets of ranks, then invoices


# ---- permutations and forecasts --------------------------------------------------


def test_permutations_are_seeded_by_rank(spark):
    f = catalog.frames(spark, SF)
    config = pricing.PricingConfig(min_lines=20, min_weeks=10, min_week_prices=2, permutations=49)
    table = {r["StockCode"]: r["perm_p"] for r in pricing.slopes(f.sales, config).collect()}
    panel = pricing.weekly(f.sales, config).toPandas()
    assert len(table) >= 3
    for i, code in enumerate(sorted(table)):
        d = panel[panel["StockCode"] == code].sort_values("week")
        x, y = d["log_price"].to_numpy(), d["log_units_adj"].to_numpy()
        x = x - x.mean()
        observed = abs(np.polyfit(d["log_price"], y, 1)[0])
        rng = np.random.default_rng([config.seed, i])
        draws = np.array([rng.permutation(y) for _ in range(49)])
        null = np.abs((draws - draws.mean(axis=1, keepdims=True)) @ x / (x @ x))
        assert abs(table[code] - ((null >= observed - 1e-12).sum() + 1) / 50) < 1e-9


def test_forecasts_from_sql_and_models_of_ones_own(spark):
    rows = [(s, t, float(t * (2 if s == "b" else 1))) for s in "ab" for t in range(10)] + [("c", 0, None)]
    spark.createDataFrame(rows, "series string, t int, value double").repartition(4).createOrReplaceTempView("some_series")
    register_forecasts(spark, forecast.ALL_MODELS | {"drift": lambda y, h: y[-1] + (y[-1] - y[0]) / (len(y) - 1) * np.arange(1, h + 1)})
    ask = "SELECT * FROM forecast_series(TABLE(SELECT * FROM some_series) PARTITION BY (series) ORDER BY (t), '{}', 3)"
    got = {(r["series"], r["step"]): r["forecast"] for r in spark.sql(ask.format("drift")).collect()}
    assert got == {("a", 1): 10, ("a", 2): 11, ("a", 3): 12, ("b", 1): 20, ("b", 2): 22, ("b", 3): 24}
    assert {r["forecast"] for r in spark.sql(ask.format("naive")).collect()} == {9.0, 18.0}
    with pytest.raises(Exception, match="no model 'none'"):
        spark.sql(ask.format("none")).collect()
