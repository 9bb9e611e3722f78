"""Returns: rates, attribution to earlier sales, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import reaching
from ..functions.timeutil import floor_days, ratio, total

#: Lag buckets in whole days, both ends included.
LAGS = (("same day", 0, 0), ("1-7 days", 1, 7), ("8-30 days", 8, 30), ("31-90 days", 31, 90), ("91-365 days", 91, 365), ("over 365 days", 366, 2**31 - 1))


def overview(sales: DataFrame, returns: DataFrame) -> DataFrame:
    zero = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))
    s = sales.agg(zero(total("Revenue"), "double").alias("gross_value"), zero(F.sum("Quantity"), "long").alias("gross_units"), F.count("*").alias("gross_lines"), F.count_distinct("Invoice").alias("gross_invoices"))
    r = returns.agg(zero(-total("Revenue"), "double").alias("returned_value"), zero(-F.sum("Quantity"), "long").alias("returned_units"), F.count("*").alias("return_lines"), F.count_distinct("Invoice").alias("cancellation_invoices"))
    rate = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return s.crossJoin(r).select("*", (F.col("gross_value") - F.col("returned_value")).alias("net_value"), rate("returned_value", "gross_value").alias("value_return_rate"), rate("returned_units", "gross_units").alias("unit_return_rate"))


def descriptions(*frames: DataFrame) -> DataFrame:
    """The most frequent trimmed description of each code; ties go to the smallest text."""
    lines = frames[0].select("StockCode", "Description")
    for f in frames[1:]:
        lines = lines.unionAll(f.select("StockCode", "Description"))
    counts = lines.where("Description is not null and StockCode is not null").groupBy("StockCode", F.trim("Description").alias("Description")).agg(F.count("*").alias("n"))
    return counts.groupBy("StockCode").agg(F.min_by("Description", F.struct(-F.col("n"), F.col("Description"))).alias("Description"))


def by_sku(sales: DataFrame, returns: DataFrame) -> DataFrame:
    sold = sales.groupBy("StockCode").agg(F.sum("Quantity").alias("su"), total("Revenue").alias("sv"))
    back = returns.where("StockCode is not null").groupBy("StockCode").agg((-F.sum("Quantity")).alias("returned_units"), (-total("Revenue")).alias("returned_value"))
    out = back.join(sold, "StockCode", "left").join(descriptions(sales, returns), "StockCode", "left")
    su, sv = F.coalesce("su", F.lit(0)), F.coalesce("sv", F.lit(0.0))
    return out.select(
        "StockCode", F.coalesce("Description", F.lit("")).alias("Description"), su.alias("sold_units"), sv.alias("sold_value"), "returned_units", "returned_value",
        F.when(su > 0, F.col("returned_units") / su).alias("unit_return_rate"),
        F.when(sv > 0, F.col("returned_value") / sv).alias("value_return_rate"),
    )


def match_to_sales(sales: DataFrame, returns: DataFrame, slice_of: str = "MONTH") -> DataFrame:
    """Each identified return line with its customer's last earlier or simultaneous sale of the code, or null.

    Sales are reduced to distinct (customer, code, time) first. Time is cut into
    slices, so that one customer and code with very many lines are many tasks: a
    window inside each slice, over sales and returns together with sales first at
    equal times, carries the last sale forward, and a return without one in its
    slice takes the last sale of the slices before, one row for each slice. No pair
    of rows is ever formed.
    """
    # A missing code is a code of its own; without nulls, the window's partitions serve the join too.
    key, code = ["CustomerID", "code"], F.coalesce("StockCode", F.lit("\0")).alias("code")
    known = F.col("CustomerID").isNotNull()
    past = sales.where(known).select("CustomerID", code, F.col("InvoiceDate").alias("at")).distinct().select(*key, "at", F.col("at").alias("sold"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("Invoice"), F.lit(None).cast("double").alias("returned_value"))
    back = returns.where(known).select("CustomerID", code, F.col("InvoiceDate").alias("at"), F.lit(None).cast("timestamp").alias("sold"), F.lit(1).alias("kind"), "Invoice", (-F.col("Revenue")).alias("returned_value"))
    both = past.unionAll(back).withColumn("slice", F.date_trunc(slice_of, "at"))
    inside = Window.partitionBy(*key, "slice").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("own", F.last("sold", ignorenulls=True).over(inside)).where("kind = 1")
    # The last sale of each slice needs no distinct sales.
    ends = [df.where(known).select("CustomerID", code, F.date_trunc(slice_of, "InvoiceDate").alias("slice"), sold.alias("sold"), F.lit(kind).alias("kind")) for df, sold, kind in ((sales, F.col("InvoiceDate"), 0), (returns, F.lit(None).cast("timestamp"), 1))]
    before = Window.partitionBy(*key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ends[0].unionAll(ends[1]).groupBy(*key, "slice").agg(F.max("sold").alias("latest"), F.max("kind").alias("returned"))
    carried = slices.withColumn("carried", F.max("latest").over(before)).where("returned = 1 AND carried IS NOT NULL").select(*key, "slice", "carried")
    out = here.join(carried, [*key, "slice"], "left").withColumn("SaleDate", F.coalesce("own", "carried"))
    return out.select("Invoice", "CustomerID", F.nullif("code", F.lit("\0")).alias("StockCode"), F.col("at").alias("InvoiceDate"), "returned_value", "SaleDate", floor_days(F.col("at"), F.col("SaleDate")).alias("days_to_return"))


def match_stats(returns: DataFrame, matched: DataFrame) -> DataFrame:
    hit = matched.where("SaleDate is not null")
    lag = F.col("days_to_return").cast("double")
    m = hit.agg(F.count("*").alias("matched_lines"), F.coalesce(total("returned_value"), F.lit(0.0)).alias("matched_value"), F.sum("days_to_return").alias("total_lag_days"), F.median(lag).alias("median_lag_days"), (F.sum("days_to_return") / F.nullif(F.count("*"), F.lit(0))).alias("mean_lag_days"), F.percentile(lag, F.lit(0.25)).alias("p25_lag_days"), F.percentile(lag, F.lit(0.75)).alias("p75_lag_days"))
    r = returns.agg(F.count("*").alias("return_lines"), F.count("CustomerID").alias("identified_lines"), F.coalesce(-total("Revenue"), F.lit(0.0)).alias("returned_value"))
    share = lambda a, b: F.coalesce(ratio(F.col(a), F.col(b)), F.lit(0.0))
    return r.crossJoin(m).select("*", share("matched_lines", "return_lines").alias("matched_line_share"), share("matched_value", "returned_value").alias("matched_value_share"))


def lag_buckets(matched: DataFrame) -> DataFrame:
    spark = matched.sparkSession
    bounds = spark.createDataFrame([(k, *x) for k, x in enumerate(LAGS)], "pos int, lag_bucket string, lo long, hi long")
    d = F.col("days_to_return")
    at = F.when(d == 0, 0)
    for k, (_, lo, hi) in enumerate(LAGS[1:], 1):
        at = at.when((d >= lo) & (d <= hi), k)
    sums = matched.where("SaleDate is not null").groupBy(at.alias("pos")).agg(F.count("*").alias("n"), total("returned_value").alias("v"))
    out = bounds.join(F.broadcast(sums), "pos", "left").select("pos", "lag_bucket", F.coalesce("n", F.lit(0)).alias("lines"), F.coalesce("v", F.lit(0.0)).alias("returned_value"))
    return out.withColumn("line_share", F.coalesce(ratio(F.col("lines"), F.sum("lines").over(Window.partitionBy())), F.lit(0.0)))


def by_country(sales: DataFrame, returns: DataFrame, n: int = 10) -> DataFrame:
    sold = sales.groupBy("Country").agg(total("Revenue").alias("sold_value"))
    back = returns.groupBy("Country").agg((-total("Revenue")).alias("r"))
    out = sold.join(back, "Country", "left").select("Country", "sold_value", F.coalesce("r", F.lit(0.0)).alias("returned_value"))
    return out.withColumn("value_return_rate", ratio(F.col("returned_value"), F.col("sold_value"))).orderBy(F.desc("sold_value"), "Country").limit(n)


def monthly(sales: DataFrame, returns: DataFrame) -> DataFrame:
    gross = sales.groupBy("YearMonth").agg(total("Revenue").alias("gross"))
    back = returns.groupBy("YearMonth").agg((-total("Revenue")).alias("r"))
    out = gross.join(back, "YearMonth", "left").select("YearMonth", "gross", F.coalesce("r", F.lit(0.0)).alias("returned"))
    return out.select("*", (F.col("gross") - F.col("returned")).alias("net"), ratio(F.col("returned"), F.col("gross")).alias("value_return_rate"))


def concentration(skus: DataFrame, top: int = 10) -> DataFrame:
    """Share of the leading codes, and how many codes make 80 % of returned value."""
    rows = skus.select(F.col("returned_value").cast("decimal(18,6)").alias("v"), (-F.col("returned_value")).alias("by"), "StockCode")
    reach = reaching(rows, "by", "StockCode", "v", 0.8)
    lead = rows.orderBy("by", "StockCode").limit(top).agg(F.sum("v").alias("lead"))
    some = F.col("all") > 0
    return reach.crossJoin(F.broadcast(lead)).select(
        F.lit(top).alias("top_n"), F.coalesce(F.when(some, F.col("lead").cast("double") / F.col("all").cast("double")), F.lit(0.0)).alias("top_n_share"),
        F.coalesce(F.when(some, F.col("reach")), F.lit(0)).alias("skus_to_80pct"), F.col("n").alias("n_returned_skus"),
    )
