"""Cohort retention, censored on the right."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import last_complete_month, month_index, month_label


def activity(sales: DataFrame) -> DataFrame:
    """(CustomerID, ym, cohort): distinct active months of known customers with their first month."""
    months = sales.where("CustomerID is not null").select("CustomerID", month_index("InvoiceDate").alias("ym")).distinct()
    return months.withColumn("cohort", F.min("ym").over(Window.partitionBy("CustomerID")))


def horizon(sales: DataFrame) -> DataFrame:
    """One row: the last complete month of known customers."""
    return sales.where("CustomerID is not null").agg(last_complete_month(F.max("InvoiceDate")).alias("last_complete"))


def sizes(sales: DataFrame) -> DataFrame:
    return activity(sales).where("ym = cohort").groupBy("cohort").agg(F.count("*").alias("size"))


def active_counts(sales: DataFrame) -> DataFrame:
    return activity(sales).groupBy("cohort", (F.col("ym") - F.col("cohort")).alias("k")).agg(F.count("*").alias("active"))


def triangle(sales: DataFrame) -> DataFrame:
    """cohort, k, size, active, retention: retention is null where month cohort + k is not complete.

    Offset 0 is always 1. Offsets run up to the last complete month from the first
    cohort; a cohort begun in the partial month has offset 0 alone.
    """
    counts = active_counts(sales)
    size = counts.where("k = 0").select("cohort", F.col("active").alias("size"))
    span = size.agg(F.min("cohort").alias("first")).crossJoin(horizon(sales))
    grid = size.crossJoin(F.broadcast(span)).where("last_complete >= first").select("cohort", "size", "last_complete", F.explode(F.sequence(F.lit(0), F.col("last_complete") - F.col("first"))).alias("k"))
    out = grid.join(counts, ["cohort", "k"], "left")
    seen = F.col("cohort") + F.col("k") <= F.col("last_complete")
    share = F.when(F.col("k") == 0, F.lit(1.0)).when(seen, F.coalesce("active", F.lit(0)) / F.col("size"))
    return out.select("cohort", month_label("cohort").alias("label"), "k", "size", F.when(seen | (F.col("k") == 0), F.coalesce("active", F.lit(0))).alias("active"), share.alias("retention"))


def curve(cells: DataFrame) -> DataFrame:
    """Size-weighted retention by offset over the cohorts observed there."""
    return cells.where("retention is not null").groupBy("k").agg(F.count("*").alias("cohorts"), F.sum("size").alias("customers"), (F.sum(F.when(F.col("k") == 0, F.col("size")).otherwise(F.col("active"))) / F.sum("size")).alias("retention"))


def wide(cells: DataFrame, offsets: int) -> DataFrame:
    """One row for each cohort, columns m0..mK in percent."""
    return cells.groupBy("cohort", "label", "size").pivot("k", list(range(offsets + 1))).agg(F.first("retention") * 100).select("cohort", "label", "size", *[F.col(str(k)).alias(f"m{k}") for k in range(offsets + 1)])


def movement(cells: DataFrame) -> DataFrame:
    """One row: retention in months 1 and 6, points moved, and the verb for it; null where a month is not complete."""
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("retention")))
    out = curve(cells).agg(at(1).alias("month_1"), at(6).alias("month_6")).withColumn("points", 100 * (F.col("month_6") - F.col("month_1")))
    return out.withColumn("verb", F.when(F.abs("points") < 2, "holds").when(F.col("points") > 0, "rises").when(F.col("points") < 0, "falls"))


def headline(cells: DataFrame) -> str:
    """Months 1 and 6 in a sentence."""
    row = movement(cells).first()
    if row["points"] is None:
        return "Too few complete months for a retention headline."
    return f"Retention {row['verb']} from {100 * row['month_1']:.1f}% in month 1 to {100 * row['month_6']:.1f}% in month 6."
