"""Price ladders and price-quantity slopes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.timeutil import close, total
from .returning import descriptions


@dataclass(frozen=True)
class PricingConfig:
    min_prices: int = 4
    min_lines: int = 200
    min_weeks: int = 12
    min_week_prices: int = 3
    permutations: int = 199
    seed: int = 42


def week_key() -> Column:
    return F.col("ISOYear") * 100 + F.col("ISOWeek")


def posted_price(df: DataFrame, *keys: str) -> DataFrame:
    """The price most lines have; ties go to the lower one."""
    n = df.groupBy(*keys, "Price").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.min_by("Price", F.struct(-F.col("n"), F.col("Price"))).alias("posted_price"))


def qualifying(sales: DataFrame, config: PricingConfig = PricingConfig()) -> DataFrame:
    return sales.groupBy("StockCode").agg(F.count_distinct("Price").alias("p"), F.count("*").alias("n")).where((F.col("p") >= config.min_prices) & (F.col("n") >= config.min_lines)).select("StockCode")


def _tracked(sales: DataFrame, config: PricingConfig) -> DataFrame:
    return sales.join(qualifying(sales, config), "StockCode", "left_semi")


def ladder(sales: DataFrame, config: PricingConfig = PricingConfig()) -> DataFrame:
    """(StockCode, Price): lines, units, revenue, share of the code's units, whether it is the posted price.

    Lines are reduced to rungs first; everything else is computed on rungs.
    """
    rungs = _tracked(sales, config).groupBy("StockCode", "Price").agg(F.count("*").alias("lines"), F.sum("Quantity").alias("units"), total("Revenue").alias("revenue"))
    posted = rungs.groupBy("StockCode").agg(F.min_by("Price", F.struct(-F.col("lines"), F.col("Price"))).alias("posted_price"), F.sum("units").alias("all_units"))
    return rungs.join(posted, "StockCode").select("StockCode", "Price", "lines", "units", "revenue", (F.col("units") / F.col("all_units")).alias("unit_share"), close(F.col("Price"), F.col("posted_price")).alias("is_posted"))


def profile(sales: DataFrame, config: PricingConfig = PricingConfig()) -> DataFrame:
    """One row for each qualifying code: rungs, volumes, posted and realized price, spread, unit shares around the posted price."""
    rungs = _tracked(sales, config).groupBy("StockCode", "Price").agg(F.count("*").alias("n"), F.sum("Quantity").alias("u"), total("Revenue").alias("r"))
    per = rungs.groupBy("StockCode").agg(
        F.count("*").alias("rungs"), F.sum("n").alias("lines"), F.sum("u").alias("units"), total("r").alias("revenue"),
        F.min_by("Price", F.struct(-F.col("n"), F.col("Price"))).alias("posted_price"),
        F.percentile("Price", F.lit(0.1), F.col("n")).alias("price_p10"), F.percentile("Price", F.lit(0.9), F.col("n")).alias("price_p90"),
    )
    at = close(F.col("Price"), F.col("posted_price"))
    side = lambda c: F.sum(F.when(c, F.col("u")).otherwise(0))
    split = rungs.join(per.select("StockCode", "posted_price"), "StockCode").groupBy("StockCode").agg(
        side(~at & (F.col("Price") < F.col("posted_price"))).alias("below"), side(at).alias("at"), side(~at & (F.col("Price") > F.col("posted_price"))).alias("above")
    )
    out = per.join(split, "StockCode").join(descriptions(sales), "StockCode", "left")
    realized = F.col("revenue") / F.col("units")
    share = lambda c: (F.col(c) / F.col("units")).alias(f"unit_share_{c}")
    return out.select(
        "StockCode", F.coalesce("Description", F.lit("")).alias("Description"), "rungs", "lines", "units", "revenue", "posted_price", realized.alias("realized_price"),
        (realized / F.col("posted_price")).alias("realization"), "price_p10", "price_p90", (F.col("price_p90") / F.col("price_p10")).alias("spread"), share("below"), share("at"), share("above"),
    )


def weekly(sales: DataFrame, config: PricingConfig = PricingConfig()) -> DataFrame:
    """(StockCode, week): posted price, units, their logs, and log units less the centred log of all units of the week."""
    sub = _tracked(sales, config).withColumn("week", week_key())
    panel = posted_price(sub, "StockCode", "week").join(sub.groupBy("StockCode", "week").agg(F.sum("Quantity").alias("units")), ["StockCode", "week"]).where("units > 0")
    market = sales.groupBy(week_key().alias("week")).agg(F.log(F.sum("Quantity").cast("double")).alias("lm"))
    mean = market.agg((F.sum(F.col("lm").cast("decimal(18,12)")).cast("double") / F.count("*")).alias("mean"))
    market = market.crossJoin(F.broadcast(mean)).select("week", (F.col("lm") - F.col("mean")).alias("lm"))
    return panel.join(market, "week").select("StockCode", "week", "posted_price", "units", F.log("posted_price").alias("log_price"), F.log("units").alias("log_units"), (F.log("units") - F.col("lm")).alias("log_units_adj"))


def within_week_slopes(sales: DataFrame, config: PricingConfig = PricingConfig()) -> DataFrame:
    """Slope of log units on log price after both lose their mean of the code's week.

    Sums around week means come from sums by week, so no window over lines is needed.
    """
    sub = _tracked(sales, config).select("StockCode", week_key().alias("week"), F.log("Price").alias("x"), F.log("Quantity").alias("y"))
    w = sub.groupBy("StockCode", "week").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))
    g = w.groupBy("StockCode").agg(F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")).alias("a"), F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")).alias("b"))
    return g.select("StockCode", F.when(F.col("a") > 1e-12, F.col("b") / F.col("a")).alias("slope_within_week"))


def slopes(sales: DataFrame, config: PricingConfig = PricingConfig(), permute: bool = True) -> DataFrame:
    """Three slopes of each code with enough weeks and weekly prices, and a seeded permutation p-value."""
    panel = weekly(sales, config)
    # Counts and the sums of both slopes in one pass over the panel.
    x, n = "log_price", F.col("weeks")
    sums = panel.groupBy("StockCode").agg(
        F.count("*").alias("weeks"), F.count_distinct("posted_price").alias("week_prices"), F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(x)).alias("sxx"),
        *[e for y in ("log_units", "log_units_adj") for e in (F.sum(y).alias(f"s_{y}"), F.sum(F.col(x) * F.col(y)).alias(f"sx_{y}"))],
    )
    sums = sums.where((F.col("weeks") >= config.min_weeks) & (F.col("week_prices") >= config.min_week_prices))
    spread = F.col("sxx") - F.col("sx") * F.col("sx") / n
    slope = lambda y: F.when(spread > 1e-12, (F.col(f"sx_{y}") - F.col("sx") * F.col(f"s_{y}") / n) / spread)
    fit = sums.select("StockCode", "weeks", "week_prices", slope("log_units").alias("slope_between_week"), slope("log_units_adj").alias("slope_market_adj"))
    out = fit.join(within_week_slopes(sales, config), "StockCode", "left").select("StockCode", "weeks", "week_prices", "slope_within_week", "slope_between_week", "slope_market_adj")
    if not permute:
        return out
    # A code's draws are seeded by its place among the fitted codes, so they do not depend on partitions.
    named = ranked(fit.select("StockCode"), {"i": "StockCode"}, "StockCode").select("StockCode", (F.col("i") - 1).alias("i"))
    draws, seed = config.permutations, config.seed

    def test(pdf):
        pdf = pdf.sort_values("week")
        x, y = pdf["log_price"].to_numpy(), pdf["log_units_adj"].to_numpy()
        dx = x - x.mean()
        sxx = float(dx @ dx)
        p = None
        if sxx > 1e-12:
            observed = abs(float(dx @ (y - y.mean())) / sxx)
            rng = np.random.default_rng([seed, int(pdf["i"].iloc[0])])
            null = np.array([rng.permutation(y) for _ in range(draws)]) @ dx / sxx
            p = (int((np.abs(null) >= observed).sum()) + 1) / (draws + 1)
        return pdf[["StockCode"]].head(1).assign(perm_p=p)

    tested = panel.join(named, "StockCode").groupBy("StockCode").applyInPandas(test, "StockCode string, perm_p double")
    return out.join(tested, "StockCode", "left")


def overview(sales: DataFrame, table: DataFrame, fitted: DataFrame) -> DataFrame:
    """One row of headline numbers; unit shares are weighted by units."""
    prices = sales.groupBy("StockCode").agg(F.count_distinct("Price").alias("p")).agg(F.count("*").alias("n_skus"), F.count_if(F.col("p") > 1).alias("n_multi_price_skus"))
    money = sales.agg(total("Revenue").alias("all_revenue"))
    dec = lambda c: c.cast("decimal(28,8)")
    mean = lambda c: (F.sum(dec(F.col(c) * F.col("units"))).cast("double") / F.sum("units")).alias(c)
    prof = table.agg(F.count("*").alias("n_qualifying"), total("revenue").alias("qualifying_revenue"), F.median("rungs").cast("double").alias("median_rungs"), F.median("spread").alias("median_spread"), mean("unit_share_below"), mean("unit_share_at"), mean("unit_share_above"), F.sum(dec(F.col("posted_price") * F.col("units"))).cast("double").alias("revenue_at_posted"))
    ok = fitted.where("slope_within_week is not null and slope_market_adj is not null")
    fit = ok.agg(F.count("*").alias("n_fitted"), F.median("slope_within_week").alias("median_slope_within_week"), F.median("slope_between_week").alias("median_slope_between_week"), F.median("slope_market_adj").alias("median_slope_market_adj"), (F.count_if(F.col("slope_market_adj") < 0) / F.nullif(F.count("*"), F.lit(0))).alias("share_slope_negative"), F.when(F.count("*") >= 3, F.corr("slope_within_week", "slope_market_adj")).alias("slope_agreement_corr"))
    out = prices.crossJoin(money).crossJoin(prof).crossJoin(fit)
    return out.select(
        "n_skus", "n_multi_price_skus", (F.col("n_multi_price_skus") / F.nullif(F.col("n_skus"), F.lit(0))).alias("multi_price_share"), "n_qualifying", "qualifying_revenue",
        (F.col("qualifying_revenue") / F.col("all_revenue")).alias("qualifying_revenue_share"), "median_rungs", "median_spread", "unit_share_below", "unit_share_at", "unit_share_above",
        "revenue_at_posted", (F.col("qualifying_revenue") / F.col("revenue_at_posted")).alias("realization"), "n_fitted", "median_slope_within_week", "median_slope_between_week",
        "median_slope_market_adj", "share_slope_negative", "slope_agreement_corr",
    )
