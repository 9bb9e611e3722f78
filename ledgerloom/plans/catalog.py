"""Registry of the retail queries and of their SQL oracles."""

from __future__ import annotations

from dataclasses import replace
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basket, cleaning, clv, cohort, explore, forecast, lifecycle, pricing, quality, returning, rfm
from ..sources.adapter import raw_lines
from ..sources.lines import typed
from . import reports
from .oracles import EUROPE, ORACLES

_HELD: dict[tuple[str, str], SimpleNamespace] = {}
BASKET = basket.BasketConfig(top_items=25, min_support=0.005, min_confidence=0.03, min_lift=1.0)
PRICING = pricing.PricingConfig(min_lines=100)
BGNBD = clv.BgNbd(0.55, 12.0, 0.8, 2.5)
GAMMA = clv.GammaGamma(2.2, 3.5, 440.0)


def frames(spark: SparkSession, sf_dir: str) -> SimpleNamespace:
    """Raw lines, sales, returns and the step log; raw, sales and returns are cached for all queries of a session (memory, then disk)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        raw = raw_lines(spark, sf_dir).persist()
        out = cleaning.clean(raw)
        _HELD[key] = SimpleNamespace(raw=raw, sales=out.sales.persist(), returns=out.returns.persist(), log=out.log)
    return _HELD[key]


def _day(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n in names})


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _holdout(f) -> tuple:
    row = clv.window(f.sales).first()
    return (row["calibration_end"], row["holdout_end"]) if row else (None, None)


def _cln2(f):
    return f.raw.select(*cleaning.KEY).dropDuplicates().groupBy(cleaning.is_cancellation(F.col("Invoice")).alias("cancelled"), "Country").agg(F.count("*").alias("n"), F.sum("Quantity").alias("units"))


def _cln3(f):
    return f.raw.select(*cleaning.KEY).dropDuplicates().groupBy("StockCode", cleaning.is_non_product(F.col("StockCode")).alias("non_product")).agg(F.count("*").alias("n"))


def _cln7(f):
    out = _day(f.sales, "Date")
    return out.select("Invoice", "StockCode", "Description", "Quantity", "Price", "CustomerID", "Country", "KnownCustomer", "Revenue", "Date", "Year", "Month", "YearMonth", "ISOYear", "ISOWeek")


def _sets(f):
    """Itemsets, the number of baskets and the baskets; made once for all basket queries of a session."""
    if not hasattr(f, "sets"):
        f.sets = _mined(f)
    return f.sets


def _mined(f):
    pairs = basket.baskets(basket.all_items(f.sales, basket.catalog(f.sales, BASKET.top_items)))
    return (*basket.itemsets(pairs, BASKET), pairs)


def _rules(f):
    sets, n, _ = _sets(f)
    return basket.rules(sets, n, BASKET)


def _cross_check(f):
    """Itemsets on which the level-wise miner and MLlib's FP-growth differ: none."""
    sets, n, pairs = _sets(f)
    ours, theirs = sets.select("size", "a", "b", "c", "count"), basket.fp_growth(pairs, n, BASKET)
    return ours.exceptAll(theirs).unionAll(theirs.exceptAll(ours)).agg(F.count("*").alias("differences"))


def _quality(f):
    config = replace(quality.retail_config(), rules=(*quality.retail_config().rules[:2], quality.Rule("InvoiceDate within window", "InvoiceDate", "between", ("1996-01-01", "2001-01-01"))))
    return quality.findings(f.raw.drop("SourceSheet"), config), config


def _inferred(f):
    """Findings of the lines under a config inferred from their types."""
    return quality.findings(f.raw.select(*cleaning.KEY))


def _domain(f):
    """Lines whose country is not among those of Europe."""
    return quality.findings(f.raw.select("Country"), quality.QualityConfig(columns={"Country": quality.ColumnRule(allowed=EUROPE)}, dedup_columns=()))


def _compared(f):
    """Scores of the raw lines and of the cleaned sales by dimension, the total first."""
    cards = [quality.assess(x.select(*cleaning.KEY), quality.retail_config()) for x in (f.raw, f.sales)]
    return f.raw.sparkSession.createDataFrame(quality.compare(*cards), "dimension string, before double, after double")


def _loaded(f):
    """The raw lines as text, as a CSV file has them, typed again and summed by sheet."""
    text = f.raw.select("Invoice", "StockCode", "Description", F.concat(F.col("Quantity").cast("string"), F.lit(".0")).alias("Quantity"), F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"), F.col("Price").cast("string").alias("Price"), F.concat(F.col("CustomerID").cast("string"), F.lit(".0")).alias("Customer ID"), "Country", "SourceSheet")
    out = typed(text).groupBy("SourceSheet").agg(
        F.count("*").alias("lines"), F.count("Description").alias("described"), F.sum("Quantity").alias("units"), F.sum(F.col("Price").cast("decimal(18,6)")).cast("double").alias("prices"),
        F.count("CustomerID").alias("known"), F.sum("CustomerID").alias("customers"), F.min("InvoiceDate").alias("first"), F.max("InvoiceDate").alias("last"),
    )
    return _day(out, "first", "last")


def _fp_growth(f):
    """Itemsets mined by MLlib's FP-growth from all baskets."""
    _, n, pairs = _sets(f)
    return basket.fp_growth(pairs, n, BASKET)


def _assessed(f, frame="raw"):
    card = quality.assess(getattr(f, frame).select(*cleaning.KEY), quality.retail_config())
    return f.raw.sparkSession.createDataFrame([(d, s, st, card.score, card.grade) for d, (s, st) in card.dimensions.items()], "dimension string, score double, status string, total double, grade string")


def _clv_table(f):
    summary = clv.summarize(f.sales)
    return clv.clv_table(summary, clv.fit_bgnbd(summary), clv.fit_gamma_gamma(summary))


def _clv_validation(f):
    cal, hold = _holdout(f)
    _, rows = clv.validate(f.sales, cal, hold)
    return clv.by_frequency(rows, "predicted", "actual")


def _days(cal, hold) -> int:
    return (pd.Timestamp(hold) - pd.Timestamp(cal)).days


def _clv_accuracy(f):
    """How the holdout came out under given parameters."""
    cal, hold = _holdout(f)
    return clv.accuracy(clv.predicted(clv.holdout_actuals(f.sales, cal, hold), BGNBD, _days(cal, hold)))


def _clv_fit(f):
    summary = clv.summarize(f.sales)
    p, g = clv.fit_bgnbd(summary), clv.fit_gamma_gamma(summary)
    return f.sales.sparkSession.createDataFrame([(p.r, p.alpha, p.a, p.b, p.log_likelihood, p.converged, g.p, g.q, g.v, g.population_mean(), g.log_likelihood, g.converged)], "r double, alpha double, a double, b double, purchases_ll double, purchases_converged boolean, p double, q double, v double, population_mean double, values_ll double, values_converged boolean")


def _weeks(f):
    """Weekly revenue, one row a week, cached for all forecasting queries of a session."""
    if not hasattr(f, "weeks"):
        f.weeks = forecast.weekly_revenue(f.sales).persist()
    return f.weeks


def _errors(f):
    weeks = _weeks(f)
    return forecast.baseline_errors(weeks, forecast.fold_origins(weeks))


_MADE = {
    "src3_typed_lines": _loaded,
    "ing1_raw_quality_report": lambda f: cleaning.raw_report(f.raw),
    "cln1_dedup": lambda f: _day(f.raw.select(*cleaning.KEY).dropDuplicates(), "InvoiceDate"),
    "cln2_cancellations": _cln2,
    "cln3_non_product": _cln3,
    "cln6_known_customers": lambda f: f.sales.groupBy("KnownCustomer").agg(F.count("*").alias("n")),
    "cln7_derived": _cln7,
    "cln8_step_log": lambda f: f.log,
    "cln9_returns": lambda f: f.returns.select("Invoice", "StockCode", "Quantity", "Price", "CustomerID", "Country", "Revenue", "YearMonth"),
    "eda1_monthly_revenue": lambda f: explore.monthly_revenue(f.sales),
    "eda2_top_products": lambda f: explore.top_products(f.sales),
    "eda3_top_countries": lambda f: explore.top_countries(f.sales),
    "eda4_order_values": lambda f: explore.order_values(f.sales),
    "eda4_order_value_summary": lambda f: explore.order_value_summary(f.sales),
    "eda5_returns_rate": lambda f: explore.return_rate(f.sales, f.returns),
    "eda6_missing_customers": lambda f: explore.missing_customers(f.sales),
    "ret1_overview": lambda f: returning.overview(f.sales, f.returns),
    "ret2_descriptions": lambda f: returning.descriptions(f.sales, f.returns),
    "ret3_by_sku": lambda f: returning.by_sku(f.sales, f.returns),
    "ret4_matched_lines": lambda f: _day(returning.match_to_sales(f.sales, f.returns), "InvoiceDate", "SaleDate"),
    "ret4_match_stats": lambda f: returning.match_stats(f.returns, returning.match_to_sales(f.sales, f.returns)),
    "ret5_lag_buckets": lambda f: returning.lag_buckets(returning.match_to_sales(f.sales, f.returns)),
    "ret6_by_country": lambda f: returning.by_country(f.sales, f.returns),
    "ret7_monthly": lambda f: returning.monthly(f.sales, f.returns),
    "ret8_concentration": lambda f: returning.concentration(returning.by_sku(f.sales, f.returns)),
    "ret9_sku_export": lambda f: reports.sku_export(f),
    "rfm1_table": lambda f: rfm.rfm_table(f.sales),
    "rfm2_scores": lambda f: rfm.scores(rfm.rfm_table(f.sales)),
    "rfm3_segments": lambda f: rfm.segments(rfm.rfm_table(f.sales)).select("CustomerID", "R", "F", "Segment"),
    "rfm4_summary": lambda f: rfm.summary(rfm.segments(rfm.rfm_table(f.sales))),
    "coh1_assignment": lambda f: cohort.activity(f.sales),
    "coh2_last_complete_month": lambda f: cohort.horizon(f.sales),
    "coh3_sizes": lambda f: cohort.sizes(f.sales),
    "coh4_triangle": lambda f: cohort.triangle(f.sales),
    "coh5_curve": lambda f: cohort.curve(cohort.triangle(f.sales)),
    "coh6_wide": lambda f: cohort.wide(cohort.triangle(f.sales), 12),
    "coh7_movement": lambda f: _rounded(cohort.movement(cohort.triangle(f.sales)), 10, "month_1", "month_6", "points"),
    "lif1_coverage": lambda f: lifecycle.coverage(f.sales),
    "lif4_stages": lambda f: lifecycle.grid(f.sales).drop("revenue"),
    "lif5_monthly": lambda f: lifecycle.monthly(lifecycle.grid(f.sales)),
    "lif6_flows": lambda f: lifecycle.flows(lifecycle.grid(f.sales)),
    "lif7_gaps": lambda f: lifecycle.gap_stats(f.sales),
    "lif8_headline": lambda f: lifecycle.headline(lifecycle.monthly(lifecycle.grid(f.sales))),
    "clv1_summary": lambda f: clv.summarize(f.sales),
    "clv2_log_likelihood": lambda f: _rounded(clv.log_likelihood(clv.summarize(f.sales), BGNBD), 4, "ll"),
    "clv3_fit": _clv_fit,
    "clv4_expected_purchases": lambda f: clv.predicted(clv.summarize(f.sales), BGNBD, 180).select("CustomerID", F.round("predicted", 6).alias("predicted")),
    "clv5_tracking": lambda f: _rounded(clv.tracking(clv.summarize(f.sales), BGNBD), 5, "expected"),
    "clv6_prob_alive": lambda f: clv.summarize(f.sales).select("CustomerID", F.round(clv.prob_alive(BGNBD, F.col("frequency"), F.col("recency"), F.col("T")), 8).alias("prob_alive")),
    "clv7_value_log_likelihood": lambda f: _rounded(clv.value_log_likelihood(clv.summarize(f.sales), GAMMA), 4, "ll", "correlation", "population_mean"),
    "clv8_expected_value": lambda f: clv.summarize(f.sales).select("CustomerID", F.round(clv.expected_value(GAMMA, F.col("frequency"), F.col("monetary_value")), 6).alias("expected_value")),
    "clv9_table": _clv_table,
    "clv10_holdout_actuals": lambda f: clv.holdout_actuals(f.sales, *_holdout(f)).drop("monetary_value"),
    "clv10_validation": _clv_validation,
    "clv10_accuracy": lambda f: _rounded(_clv_accuracy(f), 6, "predicted_total", "ratio", "mae", "correlation"),
    "clv11_by_frequency": lambda f: clv.by_frequency(clv.holdout_actuals(f.sales, *_holdout(f)), "actual"),
    "clv12_window": lambda f: _day(clv.window(f.sales), "calibration_end", "holdout_end"),
    "clv13_concentration": lambda f: clv.concentration(rfm.rfm_table(f.sales), "Monetary"),
    "clv14_lorenz": lambda f: clv.lorenz(rfm.rfm_table(f.sales), "Monetary"),
    "fc1_weekly_revenue": lambda f: _day(forecast.weekly_revenue(f.sales), "week"),
    "fc3_holt_winters": lambda f: _rounded(forecast.code_forecasts(f.sales, ["holt_winters_fixed"]), 6, "forecast"),
    "fc4_tuned_holt_winters": lambda f: _rounded(forecast.code_forecasts(f.sales, ["holt_winters"]), 6, "forecast"),
    "fc6_baseline_errors": lambda f: _rounded(_rounded(_errors(f), 2, "mae"), 6, "mase"),
    "fc7_folds": lambda f: forecast.fold_origins(_weeks(f)),
    "fc8_baseline_summary": lambda f: _rounded(_rounded(forecast.summarize(_errors(f)), 6, "mean_mase", "worst_mase"), 2, "mean_mae"),
    "fc8_cross_validation": lambda f: forecast.cross_validate(_weeks(f)),
    "fc8_cv_summary": lambda f: forecast.summarize(forecast.cross_validate(_weeks(f))),
    "fc9_final_fold": lambda f: forecast.final_fold(_weeks(f)),
    "fc10_code_weeks": lambda f: forecast.code_weeks(f.sales).drop("first"),
    "fc10_top_code_forecasts": lambda f: _rounded(forecast.top_code_forecasts(f.sales), 6, "ZeroWeekShare", "mase_naive", "mase_seasonal_naive", "mase_ma4"),
    "fc10_series_forecasts": lambda f: _rounded(forecast.code_forecasts(f.sales, ["naive", "seasonal_naive", "ma4"]), 6, "forecast"),
    "bsk2_catalog": lambda f: basket.catalog(f.sales, BASKET.top_items),
    "bsk3_survivors": lambda f: basket.survivors(f.sales, basket.catalog(f.sales, BASKET.top_items)),
    "bsk5_itemsets": lambda f: _sets(f)[0],
    "bsk6_cross_check": _cross_check,
    "bsk9_fp_growth": _fp_growth,
    "bsk7_rules": lambda f: _rounded(_rules(f), 8, "support", "confidence", "lift", "leverage", "conviction"),
    "bsk8_best_rules": lambda f: _rounded(basket.first_by_itemset(_rules(f)).select("antecedent", "consequent", "itemset", "lift"), 8, "lift"),
    "prc4_qualifying": lambda f: pricing.qualifying(f.sales, PRICING),
    "prc5_ladder": lambda f: pricing.ladder(f.sales, PRICING),
    "prc6_profile": lambda f: _rounded(pricing.profile(f.sales, PRICING), 8, "price_p10", "price_p90", "spread"),
    "prc7_weekly": lambda f: _rounded(pricing.weekly(f.sales, PRICING), 8, "log_price", "log_units", "log_units_adj"),
    "prc8_within_week": lambda f: _rounded(pricing.within_week_slopes(f.sales, PRICING), 6, "slope_within_week"),
    "prc9_permutation_test": lambda f: pricing.slopes(f.sales, PRICING),
    "prc10_slopes": lambda f: _rounded(pricing.slopes(f.sales, PRICING, permute=False), 6, "slope_within_week", "slope_between_week", "slope_market_adj"),
    "prc11_overview": lambda f: _rounded(_rounded(_rounded(pricing.overview(f.sales, pricing.profile(f.sales, PRICING), pricing.slopes(f.sales, PRICING, permute=False)), 8, "median_spread", "unit_share_below", "unit_share_at", "unit_share_above", "realization"), 6, "median_slope_within_week", "median_slope_between_week", "median_slope_market_adj", "slope_agreement_corr"), 4, "revenue_at_posted"),
    "prc12_export": lambda f: reports.price_export(f, PRICING, permute=False),
    "qlt5_domain": _domain,
    "qlt7_inferred_findings": _inferred,
    "qlt14_compared": _compared,
    "qlt_findings": lambda f: _quality(f)[0],
    "qlt_scores": lambda f: quality.scored(*_quality(f)).select("dimension", "check", "score", "status"),
    "qlt13_dimensions": lambda f: quality.by_dimension(quality.scored(*_quality(f))),
    "qlt13_raw_scorecard": lambda f: _assessed(f),
    "qlt13_sales_scorecard": lambda f: _assessed(f, "sales"),
}


def queries():
    return {name: (lambda spark, sf_dir, make=make: make(frames(spark, sf_dir))) for name, make in _MADE.items()}


def oracle_sql():
    return dict(ORACLES)
