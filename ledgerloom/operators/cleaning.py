"""Cleaning: exact dedup, split of cancellations, removal of what is not a sale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import month_index

# Bookkeeping codes and the prefix of gift vouchers.
NON_PRODUCT = ("POST", "DOT", "C2", "D", "M", "m", "S", "B", "BANK CHARGES", "AMAZONFEE", "ADJUST", "ADJUST2", "CRUK", "TEST001", "TEST002", "PADS")
VOUCHER = "gift_"
KEY = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "CustomerID", "Country"]
STEPS = ("exact duplicates", "cancellations", "bookkeeping codes", "price not positive", "quantity not positive")


def is_non_product(code: Column) -> Column:
    return F.coalesce(code.isin(*NON_PRODUCT) | F.lower(code).startswith(VOUCHER), F.lit(False))


def is_cancellation(invoice: Column) -> Column:
    return F.coalesce(invoice.startswith("C"), F.lit(False))


def derived(df: DataFrame) -> DataFrame:
    """Revenue and calendar columns."""
    ts = F.col("InvoiceDate")
    return df.withColumns(
        {
            "Revenue": F.col("Quantity") * F.col("Price"),
            "Date": F.to_date(ts),
            "Year": F.year(ts),
            "Month": F.month(ts),
            "YearMonth": F.date_format(ts, "yyyy-MM"),
            "ISOYear": F.extract(F.lit("YEAROFWEEK"), ts).cast("int"),
            "ISOWeek": F.weekofyear(ts),
            "ym": month_index(ts),
        }
    )


@dataclass(frozen=True)
class Cleaned:
    sales: DataFrame
    returns: DataFrame
    log: DataFrame


def clean(raw: DataFrame) -> Cleaned:
    """Sales, returns and the log of removals; all lazy.

    Order: exact duplicates, cancellations, bookkeeping codes, prices and
    quantities that are not positive (null counts so); unknown customers are
    flagged and stay. Returns are the cancellations of products.
    """
    unique = raw.select(*KEY).dropDuplicates()
    product = ~is_non_product(F.col("StockCode"))
    back = is_cancellation(F.col("Invoice"))
    sales = derived(unique.where(~back & product & (F.col("Price") > 0) & (F.col("Quantity") > 0)).withColumn("KnownCustomer", F.col("CustomerID").isNotNull()))
    returns = derived(unique.where(back & product))
    return Cleaned(sales, returns, step_log(raw))


def step_log(raw: DataFrame) -> DataFrame:
    """step, rows_in, rows_out, rows_removed, pct_removed: one aggregation of all rows.

    A row is counted with the first step that removes it; of duplicates, all but
    one go in the first step.
    """
    groups = raw.groupBy(*KEY).agg(F.count("*").alias("n"))
    code = (
        F.when(is_cancellation(F.col("Invoice")), 2)
        .when(is_non_product(F.col("StockCode")), 3)
        .when(~F.coalesce(F.col("Price") > 0, F.lit(False)), 4)
        .when(~F.coalesce(F.col("Quantity") > 0, F.lit(False)), 5)
        .otherwise(6)
    )
    sums = groups.select(F.explode(F.array(F.struct(F.lit(1).alias("step"), (F.col("n") - 1).alias("n")), F.struct(code.alias("step"), F.lit(1).cast("long").alias("n")))).alias("x")).select("x.*")
    sums = sums.groupBy("step").agg(F.sum("n").alias("removed"))
    spine = raw.sparkSession.range(1, 7).select(F.col("id").cast("int").alias("step"))
    each = spine.join(F.broadcast(sums), "step", "left").select("step", F.coalesce("removed", F.lit(0)).cast("long").alias("n"))
    w = Window.orderBy(F.desc("step"))  # six rows
    each = each.withColumn("rows_in", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gone = F.when(F.col("step") < 6, F.col("n")).otherwise(0)
    name = F.element_at(F.array(*[F.lit(s) for s in (*STEPS, "unknown customers flagged")]), F.col("step"))
    return each.select(
        "step",
        name.alias("step_name"),
        F.col("rows_in").cast("long").alias("rows_in"),
        (F.col("rows_in") - gone).cast("long").alias("rows_out"),
        gone.cast("long").alias("rows_removed"),
        F.coalesce(F.round(F.try_divide(100.0 * gone, F.col("rows_in")), 2), F.lit(0.0)).alias("pct_removed"),
    )


def raw_report(raw: DataFrame) -> DataFrame:
    """One row of counts on raw lines."""
    code, back = is_non_product(F.col("StockCode")), is_cancellation(F.col("Invoice"))
    per = raw.groupBy(*KEY).agg(F.count("*").alias("n"))
    w = F.col("n")
    return per.agg(
        F.sum(w).alias("rows"),
        F.count_distinct("Invoice").alias("invoices"),
        F.count_distinct("StockCode").alias("stock_codes"),
        F.date_format(F.min("InvoiceDate"), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max("InvoiceDate"), "yyyy-MM-dd").alias("date_max"),
        F.sum(w - 1).alias("exact_duplicate_rows"),
        F.sum(F.when(F.col("CustomerID").isNull(), w).otherwise(0)).alias("missing_customer_id"),
        (F.sum(F.when(F.col("CustomerID").isNull(), w).otherwise(0)) / F.sum(w)).alias("missing_customer_id_pct"),
        F.sum(F.when(back, w).otherwise(0)).alias("cancellation_rows"),
        (F.sum(F.when(back, w).otherwise(0)) / F.sum(w)).alias("cancellation_rows_pct"),
        F.sum(F.when(F.col("Quantity") < 0, w).otherwise(0)).alias("negative_quantity_rows"),
        F.sum(F.when(F.col("Price") == 0, w).otherwise(0)).alias("zero_price_rows"),
        F.sum(F.when(F.col("Price") < 0, w).otherwise(0)).alias("negative_price_rows"),
        F.sum(F.when(code, w).otherwise(0)).alias("non_product_code_rows"),
        F.count_distinct("Country").alias("countries"),
    )
