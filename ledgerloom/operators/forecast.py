"""Weekly forecasts with rolling-origin cross-validation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.series import register_forecasts
from ..functions.timeutil import total, week_ending
from .returning import descriptions

MODELS = {"seasonal_naive": K.seasonal_naive, "holt_winters": K.holt_winters_tuned, "lag_linear": K.lag_linear}
BASELINES = ("naive", "seasonal_naive", "ma4")
#: What SQL can call by name; models of one's own can be registered beside them.
ALL_MODELS = MODELS | {"holt_winters_fixed": K.holt_winters, "naive": K.naive, "ma4": K.moving_average}


def weekly_totals(lines: DataFrame, value: Column, ts: str = "InvoiceDate") -> DataFrame:
    """(week, value, t): Monday-to-Sunday sums named by the Sunday, empty weeks 0, first and last week left out."""
    sums = lines.groupBy(week_ending(ts).alias("week")).agg(value.alias("value"))
    ends = sums.agg(F.min("week").alias("a"), F.max("week").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 7 DAYS"))).alias("week"), "a", "b").where("week > a and week < b")
    t = (F.datediff("week", "a") / 7 - 1).cast("int")
    return spine.join(sums, "week", "left").select("week", F.coalesce("value", F.lit(0.0)).alias("value"), t.alias("t"))


def weekly_revenue(sales: DataFrame) -> DataFrame:
    return weekly_totals(sales, total("Revenue"))


def fold_origins(weeks: DataFrame, horizon: int = 8, count: int = 5, step: int = 8, least: int = 56) -> DataFrame:
    """(fold, origin): training weeks of each fold that has enough of them."""
    n = weeks.agg(F.count("*").alias("n"))
    k = F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k")
    out = n.select("n", k).select((F.col("n") - horizon - (count - 1 - F.col("k")) * step).cast("int").alias("origin"), "k").where(F.col("origin") >= least)
    return out.select(F.row_number().over(Window.orderBy("origin")).alias("fold"), "origin")


def baseline_errors(weeks: DataFrame, origins: DataFrame, horizon: int = 8, m: int = K.SEASON) -> DataFrame:
    """(fold, model, mae, mase) of the last value, last season and four-week mean, in joins over week numbers alone."""
    y = weeks.select("t", F.col("value").cast("decimal(28,6)").alias("y"))
    past = y.select(F.col("t").alias("pt"), F.col("y").alias("py"))
    origins = F.broadcast(origins)  # a few folds
    tests = y.join(origins, (F.col("t") >= F.col("origin")) & (F.col("t") < F.col("origin") + horizon))
    season = F.when(F.col("origin") >= m, F.col("origin") - m + (F.col("t") - F.col("origin")) % m).otherwise(F.col("origin") - 1)
    wants = tests.select("fold", "origin", "t", "y", F.explode(F.array(F.struct(F.lit("naive").alias("model"), F.array(F.col("origin") - 1).alias("use")), F.struct(F.lit("seasonal_naive").alias("model"), F.array(season).alias("use")), F.struct(F.lit("ma4").alias("model"), F.sequence(F.col("origin") - 4, F.col("origin") - 1).alias("use")))).alias("m"))
    wants = wants.select("fold", "t", "y", "m.model", F.size("m.use").alias("k"), F.explode("m.use").alias("pt"))
    made = wants.join(past, "pt").groupBy("fold", "model", "t", "y", "k").agg((F.sum("py").cast("double") / F.col("k")).alias("f"))
    err = made.groupBy("fold", "model").agg((F.sum(F.abs(F.col("y").cast("double") - F.col("f")).cast("decimal(28,6)")).cast("double") / F.count("*")).alias("mae"))
    step = F.when(F.col("origin") > m, m).otherwise(1)
    base = y.join(origins, F.col("t") < F.col("origin")).where(F.col("t") >= step).withColumn("pt", F.col("t") - step).join(past, "pt")
    scale = base.groupBy("fold").agg((F.sum(F.abs(F.col("y") - F.col("py"))).cast("double") / F.count("*")).alias("scale"))
    return err.join(scale, "fold").select("fold", "model", "mae", F.when(F.col("scale") > 0, F.col("mae") / F.col("scale")).alias("mase"))


def cross_validate(weeks: DataFrame, horizon: int = 8, count: int = 5, step: int = 8, least: int = 56) -> DataFrame:
    """(model, fold, train_weeks, mase, mae) of every model; a task has one fold and model, and the weekly series."""
    tasks = fold_origins(weeks, horizon, count, step, least).crossJoin(weeks.sparkSession.createDataFrame([(m,) for m in MODELS], "model string"))
    rows = weeks.select("t", "value").join(F.broadcast(tasks), F.col("t") < F.col("origin") + horizon)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("t")["value"].to_numpy()
        model, fold, origin = pdf["model"].iloc[0], int(pdf["fold"].iloc[0]), int(pdf["origin"].iloc[0])
        train, test = y[:origin], y[origin : origin + horizon]
        out = MODELS[model](train, len(test))
        return pd.DataFrame([{"model": model, "fold": fold, "train_weeks": origin, "mase": K.mase(test, out, train), "mae": K.mae(test, out)}])

    return rows.groupBy("model", "fold").applyInPandas(run, "model string, fold int, train_weeks int, mase double, mae double")


def summarize(cv: DataFrame) -> DataFrame:
    """Mean and worst error of each model and the folds it wins."""
    best = cv.groupBy("fold").agg(F.min_by("model", F.struct("mase", "model")).alias("model")).groupBy("model").agg(F.count("*").alias("fold_wins"))
    mean = lambda c: (F.sum(F.col(c).cast("decimal(28,8)")).cast("double") / F.count(c)).alias(f"mean_{c}")
    out = cv.groupBy("model").agg(F.count_distinct("fold").alias("folds"), mean("mase"), F.max("mase").alias("worst_mase"), mean("mae"))
    return out.join(best, "model", "left").withColumn("fold_wins", F.coalesce("fold_wins", F.lit(0)))


def final_fold(weeks: DataFrame, horizon: int = 8) -> DataFrame:
    """(week, actual, model, forecast) for the last ``horizon`` weeks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        y = pdf["value"].to_numpy()
        if len(y) <= horizon:
            return pd.DataFrame({"week": [], "actual": [], "model": [], "forecast": []})
        out = MODELS[pdf["model"].iloc[0]](y[:-horizon], horizon)
        return pd.DataFrame({"week": pdf["week"].to_numpy()[-horizon:], "actual": y[-horizon:], "model": pdf["model"].iloc[0], "forecast": out})

    models = weeks.sparkSession.createDataFrame([(m,) for m in MODELS], "model string")
    return weeks.crossJoin(F.broadcast(models)).groupBy("model").applyInPandas(run, "week date, actual double, model string, forecast double")


def top_codes(sales: DataFrame, n: int = 10) -> DataFrame:
    return sales.groupBy("StockCode").agg(F.sum("Quantity").alias("TotalUnits")).orderBy(F.desc("TotalUnits"), "StockCode").limit(n)


def code_weeks(sales: DataFrame, n: int = 10) -> DataFrame:
    """(StockCode, t, units): weekly units of the leading codes from their first selling week on, zeros filled."""
    top = top_codes(sales, n)
    span = weekly_revenue(sales).select("week", "t")
    own = sales.join(F.broadcast(top.select("StockCode")), "StockCode", "left_semi").groupBy("StockCode", week_ending("InvoiceDate").alias("week")).agg(F.sum("Quantity").alias("units"))
    grid = span.crossJoin(F.broadcast(top.select("StockCode"))).join(own, ["StockCode", "week"], "left").select("StockCode", "t", F.coalesce("units", F.lit(0)).alias("units"))
    w = Window.partitionBy("StockCode")
    started = F.min(F.when(F.col("units") != 0, F.col("t"))).over(w)
    return grid.withColumn("first", F.coalesce(started, F.min("t").over(w))).where("t >= first").select("StockCode", "t", "units", "first")


def top_code_forecasts(sales: DataFrame, n: int = 10, hold: int = 12, m: int = K.SEASON) -> DataFrame:
    """Errors of the three baselines on weekly units of the leading codes, scaled by the one-week walk; codes with too few weeks are left out."""
    weeks = code_weeks(sales, n)
    per = weeks.groupBy("StockCode").agg(F.sort_array(F.collect_list(F.struct("t", "units"))).alias("s"))  # one entry a week
    per = per.select("StockCode", F.col("s.units").alias("y"), F.size("s").alias("WeeksActive")).where(F.col("WeeksActive") > hold + 4)
    per = per.withColumn("cut", F.col("WeeksActive") - hold)
    y = F.col("y")
    test = F.slice(y, F.col("cut") + 1, F.lit(hold))
    total_of = lambda a: F.aggregate(a, F.lit(0.0).cast("double"), lambda s, v: s + v.cast("double"))
    at = lambda i: F.element_at(y, i.cast("int")).cast("double")
    error = lambda f: F.aggregate(F.transform(test, lambda v, i: F.abs(v.cast("double") - f(i))), F.lit(0.0), lambda s, v: s + v) / hold
    season = lambda i: F.when(F.col("cut") >= m, at(F.col("cut") - m + i % m + 1)).otherwise(at(F.col("cut")))
    ma = total_of(F.slice(y, F.col("cut") - 3, F.lit(4))) / 4
    walk = F.aggregate(F.transform(F.sequence(F.lit(2), F.col("cut")), lambda i: F.abs(at(i) - at(i - 1))), F.lit(0.0), lambda s, v: s + v) / (F.col("cut") - 1)
    scaled = lambda e: F.when(walk > 0, e / walk)
    out = per.select(
        "StockCode", "WeeksActive", (F.size(F.filter(y, lambda v: v == 0)) / F.col("WeeksActive")).alias("ZeroWeekShare"),
        scaled(error(lambda i: at(F.col("cut")))).alias("mase_naive"), scaled(error(season)).alias("mase_seasonal_naive"), scaled(error(lambda i: ma)).alias("mase_ma4"),
    )
    a, b, c = F.col("mase_naive"), F.col("mase_seasonal_naive"), F.col("mase_ma4")
    best = F.when(a.isNull(), "n/a (single-spike demand)").when((a <= b) & (a <= c), "naive").when(b <= c, "seasonal_naive").otherwise("ma4")
    return out.join(top_codes(sales, n), "StockCode").join(descriptions(sales), "StockCode", "left").select("StockCode", F.coalesce("Description", F.lit("")).alias("Description"), "TotalUnits", "WeeksActive", "ZeroWeekShare", "mase_naive", "mase_seasonal_naive", "mase_ma4", best.alias("best_model"))


def seasonal_losses(cv: DataFrame) -> DataFrame:
    """In how many folds Holt-Winters does worse than last season's values."""
    wide = cv.groupBy("fold").pivot("model", ["holt_winters", "seasonal_naive"]).agg(F.first("mase"))
    return wide.agg(F.count("*").alias("folds"), F.count_if(F.col("holt_winters") > F.col("seasonal_naive")).alias("losses"))


def code_forecasts(sales: DataFrame, models: list[str], n: int = 10, horizon: int = 12) -> DataFrame:
    """(series, model, step, forecast) of the weekly units of the leading codes, in SQL through the registered table function."""
    spark = sales.sparkSession
    register_forecasts(spark, ALL_MODELS)
    view = "ledgerloom_code_weeks"
    code_weeks(sales, n).select(F.col("StockCode").alias("series"), "t", F.col("units").cast("double").alias("value")).createOrReplaceTempView(view)
    each = [spark.sql(f"SELECT * FROM forecast_series(TABLE(SELECT series, t, value FROM {view}) PARTITION BY (series) ORDER BY (t), '{m}', {int(horizon)})") for m in models]
    out = each[0]
    for df in each[1:]:
        out = out.unionAll(df)
    return out
