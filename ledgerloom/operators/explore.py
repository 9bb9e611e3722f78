"""Revenue exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import percentiles
from ..functions.timeutil import ratio, total


def monthly_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy("YearMonth").agg(total("Revenue").alias("revenue"), F.count_distinct("Invoice").alias("invoices"), F.count("*").alias("lines"))


def top_products(sales: DataFrame, n: int = 10) -> DataFrame:
    out = sales.where("Description is not null").groupBy("StockCode", "Description").agg(total("Revenue").alias("revenue"), F.sum("Quantity").alias("units"))
    return out.orderBy(F.desc("revenue"), "StockCode", "Description").limit(n)


def top_countries(sales: DataFrame, n: int = 10) -> DataFrame:
    """Revenue and share of all revenue of the leading countries."""
    out = sales.groupBy("Country").agg(total("Revenue").alias("revenue"))
    return out.crossJoin(F.broadcast(sales.agg(total("Revenue").alias("_all")))).select("Country", "revenue", ratio(F.col("revenue"), F.col("_all")).alias("share")).orderBy(F.desc("revenue"), "Country").limit(n)


def order_values(sales: DataFrame, bins: int = 59) -> DataFrame:
    """Invoice totals in log-spaced bins from 1 to the greatest; values below 1 are left out."""
    orders = sales.groupBy("Invoice").agg(total("Revenue").alias("v")).where("v > 0")
    top = orders.agg(F.max("v").alias("top"))
    at = F.least(F.floor(F.log10("v") / F.log10("top") * bins), F.lit(bins - 1)).cast("int")
    return orders.crossJoin(F.broadcast(top)).where("v >= 1").groupBy(F.when(F.col("top") > 1, at).otherwise(0).alias("bin")).agg(F.count("*").alias("orders"), total("v").alias("revenue"))


def order_value_summary(sales: DataFrame) -> DataFrame:
    orders = sales.groupBy("Invoice").agg(total("Revenue").alias("v")).where("v > 0")
    middle = percentiles(orders, [F.col("v")], [0.5]).select(F.get("q0", F.lit(0)).alias("median_value"))
    return orders.agg(F.count("*").alias("orders"), F.max("v").alias("max_value")).crossJoin(middle).select("orders", "median_value", "max_value")


def return_rate(sales: DataFrame, returns: DataFrame) -> DataFrame:
    """Returned value over gross revenue by month of sales; months without returns have 0."""
    gross = sales.groupBy("YearMonth").agg(total("Revenue").alias("gross"))
    back = returns.groupBy("YearMonth").agg((-total("Revenue")).alias("returned"))
    return gross.join(back, "YearMonth", "left").select("YearMonth", F.coalesce(ratio(F.col("returned"), F.col("gross")), F.lit(0.0)).alias("returns_rate"))


def missing_customers(sales: DataFrame) -> DataFrame:
    return sales.groupBy("YearMonth").agg((100.0 * F.sum(F.when(~F.col("KnownCustomer"), 1).otherwise(0)) / F.count("*")).alias("missing_pct"))
