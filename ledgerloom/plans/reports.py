"""Report files: six CSV reports, a workbook of tables, the quality card and headlines."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basket, cleaning, clv, cohort, explore, forecast, lifecycle, pricing, quality, returning, rfm
from ..sources import scratch, store
from ..sources.csvfile import write_csv
from ..sources.lines import load_lines, write_workbook


def frames_of(raw: DataFrame) -> SimpleNamespace:
    """Raw lines, sales, returns and the step log of one table of lines."""
    out = cleaning.clean(raw)
    return SimpleNamespace(raw=raw, sales=out.sales, returns=out.returns, log=out.log)


def load_or_sample(spark: SparkSession, path: str, sample: str | None = None) -> tuple[DataFrame, str]:
    """The lines of ``path``, or of ``sample`` where the path does not exist, and a note that says which."""
    from pyspark.errors import AnalysisException

    try:
        return load_lines(spark, path), f"lines of {path}"
    except AnalysisException as e:
        if sample is None or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return load_lines(spark, sample), f"{path} does not exist: the sample {sample} is used, and its figures stand for nothing else"


def stored_frames(spark: SparkSession, path: str, cache: str, sample: str | None = None, force: bool = False) -> tuple[SimpleNamespace, str]:
    """The frames of the store at ``cache`` where it fits the lines at ``path``, else of those lines, which are then stored; at last of ``sample``, which is not stored."""
    try:
        return store.stored(spark, cache, [path], lambda: load_lines(spark, path), force=force)
    except Exception as e:
        if sample is None or "FileNotFoundException" not in str(e):
            raise
    raw, note = load_or_sample(spark, path, sample)
    return frames_of(raw), note


#: Analyses that can be asked for by name, with the reports each writes.
ANALYSES = {
    "cohort": ["cohort_triangle"], "lifecycle": ["lifecycle_monthly", "lifecycle_flows"], "value": ["customer_value"],
    "returns": ["returns_by_sku"], "pricing": ["price_profile"], "workbook": ["workbook"], "card": ["report_card"], "headlines": ["headlines"],
}


def _percent(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.bround(100 * F.col(n), digits) for n in names})


def sku_export(f: SimpleNamespace) -> DataFrame:
    """Returns by code, rates in percent with two digits, money with two."""
    out = _percent(returning.by_sku(f.sales, f.returns), 2, "unit_return_rate", "value_return_rate")
    return out.withColumns({c: F.bround(c, 2) for c in ("sold_value", "returned_value")})


def price_export(f: SimpleNamespace, config: pricing.PricingConfig = pricing.PricingConfig(), permute: bool = True) -> DataFrame:
    """Each qualifying code's rungs, prices, shares in percent, and slopes, rounded, with ``permute`` their permutation test too; slopes are null where none was fitted."""
    out = _percent(pricing.profile(f.sales, config), 2, "realization", "unit_share_below", "unit_share_at", "unit_share_above")
    out = out.withColumnsRenamed({c: f"{c}_pct" for c in ("realization", "unit_share_below", "unit_share_at", "unit_share_above")})
    fits = ["weeks", "slope_within_week", "slope_between_week", "slope_market_adj"] + ["perm_p"] * permute
    fitted = pricing.slopes(f.sales, config, permute).select("StockCode", *fits)
    digits = {"revenue": 2, "spread": 3} | dict.fromkeys(("posted_price", "realized_price", "price_p10", "price_p90", *fits[1:]), 4)
    columns = ["StockCode", "Description", "rungs", "lines", "units", "revenue", "posted_price", "realized_price", "realization_pct", "price_p10", "price_p90", "spread", "unit_share_below_pct", "unit_share_at_pct", "unit_share_above_pct", *fits]
    return out.join(fitted, "StockCode", "left").withColumns({c: F.bround(c, d) for c, d in digits.items()}).select(columns)


def _fits(f: SimpleNamespace) -> tuple:
    """The summary of customers and both fitted models, fitted once for all reports."""
    if not hasattr(f, "fits"):
        summary = clv.summarize(f.sales)
        f.fits = (summary, clv.fit_bgnbd(summary), clv.fit_gamma_gamma(summary))
    return f.fits


def clv_export(f: SimpleNamespace) -> DataFrame:
    return clv.clv_table(*_fits(f))


def clv_headline(f: SimpleNamespace) -> str:
    """The headline of the fitted models, with the holdout where there is one; what can't be fitted is said."""
    if not clv.summarize(f.sales).where("monetary_value > 0").take(1):
        return "no repeat customers to fit."
    window = clv.window(f.sales).first()
    return clv.headline(clv_export(f), checked=clv.validate(f.sales, *window)[1] if window else None)


def csv_reports(f: SimpleNamespace, config: pricing.PricingConfig = pricing.PricingConfig()) -> dict:
    """What makes each report, and the columns that order its rows."""
    grid = lifecycle.grid(f.sales)
    return {
        "cohort_triangle": (lambda: cohort.triangle(f.sales), ["cohort", "k"]),
        "lifecycle_monthly": (lambda: lifecycle.monthly(grid), ["month"]),
        "lifecycle_flows": (lambda: lifecycle.flows(grid), lifecycle.flows(grid).columns[:2]),
        "customer_value": (lambda: clv_export(f), ["CustomerID"]),
        "returns_by_sku": (lambda: sku_export(f), ["StockCode"]),
        "price_profile": (lambda: price_export(f, config), ["StockCode"]),
    }


def workbook(f: SimpleNamespace, config: pricing.PricingConfig = pricing.PricingConfig(), mined: basket.BasketConfig = basket.BasketConfig()) -> dict[str, DataFrame]:
    """The named tables of the workbook; empty ones are left out when it is written."""
    weeks = forecast.weekly_revenue(f.sales)
    pairs = basket.baskets(basket.all_items(f.sales, basket.catalog(f.sales, mined.top_items)))
    sets, n = basket.itemsets(pairs, mined)
    grid = lifecycle.grid(f.sales)
    return {
        "CleaningReport": f.log,
        "MonthlyRevenue": explore.monthly_revenue(f.sales),
        "RFM": rfm.summary(rfm.segments(rfm.rfm_table(f.sales))),
        "Cohort": cohort.triangle(f.sales),
        "Lifecycle": lifecycle.monthly(grid),
        "CLV": clv_export(f).orderBy(F.desc("clv"), "CustomerID").limit(50),
        "Returns": returning.overview(f.sales, f.returns),
        "PriceLadder": price_export(f, config),
        "PriceRungs": pricing.ladder(f.sales, config),
        "ForecastCV": forecast.summarize(forecast.cross_validate(weeks)),
        "TopSKUs": explore.top_products(f.sales),
        "Rules": basket.first_by_itemset(basket.rules(sets, n, mined)),
        "DataQuality": quality.scored(quality.findings(f.raw.select(*cleaning.KEY), quality.retail_config()), quality.retail_config()),
        "WeeklyRevenue": weeks,
    }


def headlines(f: SimpleNamespace, config: pricing.PricingConfig = pricing.PricingConfig()) -> list[str]:
    """A sentence for each analysis."""
    out = [cohort.headline(cohort.triangle(f.sales))]
    row = lifecycle.headline(lifecycle.monthly(lifecycle.grid(f.sales))).first()
    if row["months"]:
        ratio = "no customers were lost" if row["pooled_quick_ratio"] is None else f"the quick ratio is {row['pooled_quick_ratio']:.2f}"
        out.append(f"{row['mean_active']:,.0f} customers are active in a mean month; {ratio}, and at least 1 in {row['months_at_least_1']} of {row['months']} months.")
    r = returning.overview(f.sales, f.returns).first()
    m = returning.match_stats(f.returns, returning.match_to_sales(f.sales, f.returns)).first()
    if r["gross_value"]:
        out.append(f"Returns take {100 * (r['value_return_rate'] or 0):.2f}% of {r['gross_value']:,.0f} in sales; {100 * (m['matched_line_share'] or 0):.1f}% of return lines match an earlier sale.")
    lost = forecast.seasonal_losses(forecast.cross_validate(forecast.weekly_revenue(f.sales))).first()
    if lost["folds"]:
        out.append(f"Holt-Winters does worse than last year's weeks in {lost['losses']} of {lost['folds']} folds.")
    out.append("Predicted value: " + clv_headline(f))
    p = pricing.overview(f.sales, pricing.profile(f.sales, config), pricing.slopes(f.sales, config, permute=False)).first()
    if p["n_qualifying"]:
        out.append(f"{p['n_multi_price_skus']:,} of {p['n_skus']:,} codes sold at several prices; {p['n_qualifying']:,} qualify, with a median spread of {p['median_spread']:.2f}x.")
    return out


def report_card(f: SimpleNamespace) -> str:
    """Markdown: the quality of the raw lines and of the cleaned sales, and what changed."""
    config = quality.retail_config()
    before, after = (quality.assess(x.select(*cleaning.KEY), config) for x in (f.raw, f.sales))
    show = lambda v: "-" if v is None else f"{v:.1f}"
    lines = ["# Data quality", "", "## Raw lines", "", "```", before.render(), "```", "", "## Cleaned sales", "", "```", after.render(), "```", "", "## Before and after", "", "| Dimension | Raw | Cleaned |", "| --- | --- | --- |"]
    return "\n".join([*lines, *(f"| {d} | {show(a)} | {show(b)} |" for d, a, b in quality.compare(before, after))]) + "\n"


def export(f: SimpleNamespace, path: str, config: pricing.PricingConfig = pricing.PricingConfig(), mined: basket.BasketConfig = basket.BasketConfig(), only: list[str] | None = None) -> list[str]:
    """Write the reports under ``path``, all or those of the analyses named by ``only``, and return their names.

    Reports are single CSV files, put in place when they are whole; equal input
    gives equal bytes.
    """
    wanted = {r for a in only or ANALYSES for r in ANALYSES[a]}
    made = []
    for name, (df, order) in csv_reports(f, config).items() if wanted - {"workbook", "report_card", "headlines"} else ():
        if name in wanted:
            write_csv(df(), f"{path}/{name}.csv", *order)
            made.append(name)
    if "workbook" in wanted:
        made += write_workbook(workbook(f, config, mined), f"{path}/workbook")
    spark = f.raw.sparkSession
    for name, text in (("report_card", lambda: report_card(f)), ("headlines", lambda: "\n".join(headlines(f, config)))):
        if name in wanted:
            spark.createDataFrame([(text(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
            made.append(name)
    scratch.clear()
    return made
