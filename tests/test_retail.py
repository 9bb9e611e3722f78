"""Hand-computed cases of the retail operators."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest

from ledgerloom.functions import kernels as K
from ledgerloom.operators import basket, cleaning, clv, cohort, forecast, lifecycle, pricing, quality, returning, rfm
from ledgerloom.sources import lines

RAW = "Invoice string, StockCode string, Description string, Quantity long, InvoiceDate timestamp, Price double, CustomerID long, Country string"


def at(text):
    return datetime.fromisoformat(text)


def make(spark, rows):
    return spark.createDataFrame(rows, RAW)


@pytest.fixture(scope="module")
def traded(spark):
    rows = [
        ("100", "AA", "Widget", 5, at("2011-01-01T09:00"), 2.0, 1, "UK"),
        ("101", "AA", "Widget", 5, at("2011-01-05T09:00"), 2.0, 1, "UK"),
        ("C900", "AA", "Widget", -5, at("2011-01-10T09:00"), 2.0, 1, "UK"),
        ("102", "BB", "Box", 3, at("2011-02-01T09:00"), 4.0, 1, "UK"),
        ("C901", "CC", None, -1, at("2011-02-15T09:00"), 9.0, 1, "UK"),
        ("C902", "AA", "Widget", -2, at("2011-03-01T09:00"), 2.0, 2, "UK"),
        ("C903", "AA", "Widget", -1, at("2011-03-05T09:00"), 2.0, None, "UK"),
    ]
    return cleaning.clean(make(spark, rows))


def test_returns(traded):
    o = returning.overview(traded.sales, traded.returns).first()
    assert (o.gross_value, o.returned_value, o.net_value, o.return_lines, o.cancellation_invoices) == (32.0, 25.0, 7.0, 4, 4)
    m = returning.match_to_sales(traded.sales, traded.returns)
    hit = m.where("SaleDate is not null").collect()
    assert [(r.SaleDate, r.days_to_return) for r in hit] == [(at("2011-01-05T09:00"), 5)]
    s = returning.match_stats(traded.returns, m).first()
    assert (s.identified_lines, s.matched_line_share, s.matched_value_share) == (3, 0.25, 0.4)


def test_match_at_the_same_instant_and_floor_days(spark):
    rows = [("1", "AA", "x", 1, at("2011-01-01T10:00"), 1.0, 1, "UK"), ("C1", "AA", "x", -1, at("2011-01-01T10:00"), 1.0, 1, "UK"), ("C2", "AA", "x", -2, at("2011-01-02T09:00"), 1.0, 1, "UK")]
    c = cleaning.clean(make(spark, rows))
    assert sorted(r.days_to_return for r in returning.match_to_sales(c.sales, c.returns).collect()) == [0, 0]


def test_empty_returns(spark, traded):
    none = traded.returns.limit(0)
    assert returning.overview(traded.sales, none).first().value_return_rate == 0.0
    assert returning.by_sku(traded.sales, none).count() == 0
    assert returning.concentration(returning.by_sku(traded.sales, none)).first().skus_to_80pct == 0


def test_step_log_chains(spark):
    rows = [
        ("1", "AA", "x", 1, at("2011-01-01T10:00"), 1.0, 1, "UK"),
        ("1", "AA", "x", 1, at("2011-01-01T10:00"), 1.0, 1, "UK"),
        ("C1", "AA", "x", -1, at("2011-01-02T10:00"), 1.0, 1, "UK"),
        ("2", "POST", "x", 1, at("2011-01-01T10:00"), 1.0, 1, "UK"),
        ("3", "Gift_1", "x", 1, at("2011-01-01T10:00"), 1.0, 1, "UK"),
        ("4", "AA", "x", 1, at("2011-01-01T10:00"), None, 1, "UK"),
        ("5", "AA", None, -1, at("2011-01-01T10:00"), 1.0, None, "UK"),
        ("6", "AA", None, 1, at("2011-01-01T10:00"), 1.0, None, "UK"),
    ]
    c = cleaning.clean(make(spark, rows))
    log = c.log.orderBy("step").collect()
    assert [r.rows_removed for r in log] == [1, 1, 2, 1, 1, 0]
    assert log[0].rows_in == 8 and all(a.rows_out == b.rows_in for a, b in zip(log, log[1:]))
    assert log[-1].rows_out == c.sales.count() == 2


def life(spark, rows):
    return spark.createDataFrame([(c, at(t), float(r)) for c, t, r in rows], "CustomerID long, InvoiceDate timestamp, Revenue double")


def test_lifecycle(spark):
    sales = life(spark, [(101, "2020-01-15", 10), (101, "2020-02-20", 20), (101, "2020-04-05", 40), (102, "2020-01-31", 5), (103, "2020-03-10", 7), (104, "2020-05-02", 99)])
    config = lifecycle.LifecycleConfig(2)
    cells = lifecycle.grid(sales, config)
    m = [tuple(r) for r in lifecycle.monthly(cells).orderBy("month").select("month", "new", "retained", "resurrected", "at_risk", "dormant", "base", "active", "churned", "quick_ratio").collect()]
    assert m == [("2020-01", 2, 0, 0, 0, 0, 2, 2, None, None), ("2020-02", 0, 1, 0, 1, 0, 2, 1, 1, 0.0), ("2020-03", 1, 0, 0, 2, 0, 3, 1, 1, 1.0), ("2020-04", 0, 0, 1, 1, 1, 3, 1, 1, 1.0)]
    f = {(r["from"], r["to"]): r["n"] for r in lifecycle.flows(cells).collect()}
    assert len(f) == 30 and {k: v for k, v in f.items() if v} == {(lifecycle.ENTRY, "new"): 1, ("new", "retained"): 1, ("new", "at_risk"): 2, ("retained", "at_risk"): 1, ("at_risk", "at_risk"): 1, ("at_risk", "resurrected"): 1, ("at_risk", "dormant"): 1}
    assert tuple(lifecycle.coverage(sales).first()) == (3, 1)
    g = lifecycle.gap_stats(sales, config).first()
    assert (g.n_gaps, g.share_within_dormancy) == (2, 1.0)
    sizes = {r.cohort: r.size for r in cohort.sizes(sales).collect()}
    assert sum(v for k, v in sizes.items() if k < 2020 * 12 + 4) == sum(r[1] for r in m)
    with pytest.raises(ValueError):
        lifecycle.LifecycleConfig(0)


def test_cohort_of_the_partial_month_has_offset_zero_alone(spark):
    sales = life(spark, [(1, "2020-01-15", 1), (1, "2020-02-15", 1), (2, "2020-03-31T23:59:59", 1)])
    t = {(r.cohort, r.k): r.retention for r in cohort.triangle(sales).collect()}
    first = 2020 * 12
    assert t == {(first, 0): 1.0, (first, 1): 1.0, (first + 2, 0): 1.0, (first + 2, 1): None}


@pytest.mark.parametrize("n", [1, 2, 7, 12, 13, 101])
def test_scores_are_quantile_bins_of_ranks(spark, n):
    import pandas as pd

    rng = np.random.default_rng(n)
    f = rng.integers(1, 6, n)
    table = spark.createDataFrame([(int(i), int(10 - v), int(v), float(v)) for i, v in enumerate(f)], "CustomerID long, RecencyDays long, Frequency long, Monetary double")
    got = [r.F for r in rfm.scores(table).orderBy("CustomerID").collect()]
    want = [1] if n == 1 else (pd.qcut(pd.Series(f).rank(method="first"), 5, labels=False) + 1).tolist()
    assert got == want


def test_clv(spark):
    sales = life(spark, [(1, "2011-01-01T09:00", 100), (1, "2011-01-15T14:30", 200), (1, "2011-01-15T16:00", 50), (1, "2011-02-01T11:00", 300), (2, "2011-01-10T10:00", 500), (None, "2011-01-20T12:00", 999)])
    s = [tuple(r) for r in clv.summarize(sales, "2011-03-01").orderBy("CustomerID").collect()]
    assert s == [(1, 2, 31, 59, 275.0), (2, 0, 0, 50, 0.0)]
    p = clv.BgNbd(0.55, 12, 0.8, 2.5)
    for t in (1, 7, 30, 90, 180, 365):
        assert math.isclose(float(clv.expected_purchases(p, t, 0.0, 0.0, 0.0)), clv.expected_purchases_of_new(p, t), rel_tol=1e-12)
    assert 0 < float(clv.expected_purchases(p, 180, 300.0, 350.0, 360.0)) < 1e4


def test_baskets(spark):
    groups = [["tea", "saucer"]] * 3 + [["tea"], ["saucer"]] + [["box"]] * 5
    pairs = spark.createDataFrame([(str(k), i) for k, g in enumerate(groups) for i in g], "Invoice string, Item string")
    config = basket.BasketConfig(min_support=0.2, max_len=2, thin_count=4)
    sets, n = basket.itemsets(pairs, config)
    assert {(r.a, r.b): r.support for r in sets.collect()} == {("tea", None): 0.4, ("saucer", None): 0.4, ("box", None): 0.5, ("saucer", "tea"): 0.3}
    r = {x.antecedent: x for x in basket.rules(sets, n, config).collect()}["tea"]
    assert (r.consequent, r.support_count, r.thin_support) == ("saucer", 3, True)
    assert np.allclose([r.confidence, r.lift, r.leverage, r.conviction], [0.75, 1.875, 0.14, 2.4])
    same = basket.fp_growth(pairs, n, config)
    assert sets.select("size", "a", "b", "c", "count").exceptAll(same).count() == 0
    assert basket.min_count(0.02, 6000) == 120 and basket.min_count(0.01, 29639) == 297
    with pytest.raises(ValueError):
        basket.BasketConfig(min_support=0)


def priced(spark, rows):
    return cleaning.derived(make(spark, [(str(i), c, c, q, at("2011-01-03T09:00") + timedelta(days=7 * w), float(p), 1, "UK") for i, (c, q, p, w) in enumerate(rows)]).withColumn("KnownCustomer", __import__("pyspark").sql.functions.lit(True)))


def test_pricing(spark):
    config = pricing.PricingConfig(2, 3, 2, 2, 49)
    s = priced(spark, [("AA", 10, 2, k) for k in range(4)] + [("AA", 20, 1, 1), ("AA", 5, 4, 2)])
    lad = [tuple(r) for r in pricing.ladder(s, config).orderBy("Price").select("Price", "lines", "units", "is_posted").collect()]
    assert lad == [(1.0, 1, 20, False), (2.0, 4, 40, True), (4.0, 1, 5, False)]
    p = pricing.profile(s, config).first()
    assert (p.revenue, p.units, p.posted_price) == (120.0, 65, 2.0)
    assert np.allclose([p.realized_price, p.unit_share_below, p.unit_share_at, p.unit_share_above], [120 / 65, 20 / 65, 40 / 65, 5 / 65])
    tie = priced(spark, [("AA", 1, 3, 0), ("AA", 1, 2, 0), ("AA", 1, 4, 0)])
    assert pricing.posted_price(tie, "StockCode").first().posted_price == 2.0
    spend = priced(spark, [("AA", 40, 1, 0), ("AA", 20, 2, 0), ("AA", 10, 4, 0), ("AA", 5, 8, 0)])
    assert math.isclose(pricing.within_week_slopes(spend, config).first().slope_within_week, -1.0, rel_tol=1e-9)
    flat = priced(spark, [("AA", 1, 2, 0)] * 7 + [("AA", 2, 2, 0)])
    assert pricing.within_week_slopes(flat, pricing.PricingConfig(1, 3)).first().slope_within_week is None


def test_forecast(spark):
    assert K.mase([6, 8], [5, 6], [1, 2, 3, 4, 5], 1) == 1.5
    assert K.mase([4], [3.5], [1, 3, 2, 4, 3, 5], 2) == 0.5
    assert K.seasonal_naive(np.arange(1, 11), 6, 4).tolist() == [7, 8, 9, 10, 7, 8]
    assert K.seasonal_naive(np.array([3.0, 4.0]), 3, 4).tolist() == [4, 4, 4]
    t = np.arange(60, dtype=float)
    assert np.allclose(K.holt_winters(t, 4, 4), np.arange(60, 64), atol=1.5)
    s = spark.createDataFrame([(at("2011-01-02T10:00"), 1.0), (at("2011-01-03T00:00"), 2.0), (at("2011-01-17T00:00"), 4.0), (at("2011-01-30T00:00"), 8.0)], "InvoiceDate timestamp, Revenue double")
    w = [(str(r.week), r.value) for r in forecast.weekly_revenue(s).orderBy("week").collect()]
    assert w == [("2011-01-09", 2.0), ("2011-01-16", 0.0), ("2011-01-23", 4.0)]


def test_quality(spark):
    assert [quality.score(*x) for x in ((0, 10), (2, 10), (3, 200), (8, 200), (0, 0))] == [100, 80, 98.5, 96, 100]
    assert [quality.status(x) for x in (99.5, 99.4, 97.0, 96.9)] == ["pass", "warn", "warn", "fail"]
    df = spark.createDataFrame([(10.0, "AB12", "a"), (-1.0, "AB13", "b"), (5.0, "xx", "z"), (0.0, "AB14", "a")], "price double, code string, d string")
    config = quality.QualityConfig({"price": quality.ColumnRule(min_value=0), "code": quality.ColumnRule(regex=r"AB\d+"), "d": quality.ColumnRule(allowed=("a", "b"))}, dedup_columns=())
    assert [f["score"] for f in quality.assess(df, config).findings] == [75.0] * 3
    many = spark.createDataFrame([(i,) for i in range(100)] + [(i,) for i in range(6)], "x long")
    card = quality.assess(many)
    assert card.dimensions["Uniqueness"][1] == "fail" and card.grade == "C"
    far = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(1e7,)], "x double")
    assert quality.assess(far).dimensions["Plausibility"][1] == "warn"
    assert (quality.assess(df.limit(0)).grade, quality.assess(df.limit(0)).score) == ("F", 0.0)
    with pytest.raises(ValueError):
        quality.assess(df, quality.QualityConfig(rules=(quality.Rule("r", "price", "~", 1),)))


def test_typed_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n1,10001,,3,2011-01-01 09:00:00,x,7.0,UK\n")
    r = lines.load_lines(spark, str(tmp_path / "a.csv")).first()
    assert (r.Invoice, r.StockCode, r.Description, r.Quantity, r.Price, r.CustomerID, r.SourceSheet) == ("1", "10001", None, 3, None, 7, "a.csv")
    with pytest.raises(FileNotFoundError):
        lines.load_lines(spark)


def test_entry_and_streaming(spark, tmp_path):
    import __spark_entry__ as e
    from ledgerloom.streaming.events import weekly_values

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    spark.createDataFrame([(at("2024-01-01T10:00"), 1.0), (at("2024-01-07T23:00"), 2.0), (at("2024-01-08T00:00"), 4.0)], "ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = weekly_values(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(str(r.week), r.value) for r in spark.table("w").collect()} == {("2024-01-07", 3.0), ("2024-01-14", 4.0)}
