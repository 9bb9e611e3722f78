"""Recency, frequency and monetary segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.timeutil import floor_days, total

# Segment names in report order.
SEGMENTS = ("Champions", "Loyal Customers", "Potential Loyalist", "New Customers", "Need Attention", "About to Sleep", "At Risk", "Can't Lose Them", "Hibernating", "Lost")


def rfm_table(sales: DataFrame, snapshot=None) -> DataFrame:
    """Recency in whole days before the snapshot (by default a day after the last sale), invoices and revenue of each known customer."""
    own = sales.where("CustomerID is not null")
    at = own.agg((F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).alias("snap")) if snapshot is None else sales.sparkSession.range(1).select(F.lit(snapshot).cast("timestamp").alias("snap"))
    per = own.groupBy("CustomerID").agg(F.max("InvoiceDate").alias("last"), F.count_distinct("Invoice").alias("Frequency"), total("Revenue").alias("Monetary"))
    return per.crossJoin(F.broadcast(at)).select("CustomerID", floor_days(F.col("snap"), F.col("last")).alias("RecencyDays"), "Frequency", "Monetary")


def _fifth(rank: str) -> Column:
    """Which fifth of the ranks 1..n a row is in: bins are closed on the right and the first takes its left end."""
    rn, n = F.col(rank), F.col("n")
    return F.when(n == 1, 1).otherwise(F.greatest(F.lit(1), F.floor((5 * (rn - 1) + n - 2) / F.nullif(n - 1, F.lit(0))))).cast("int")


def scores(table: DataFrame) -> DataFrame:
    """R, F and M from 1 to 5. The ranks run over one row for each customer, all three in one pass; equal values keep the order of customers."""
    out = ranked(table.withColumn("_old", -F.col("RecencyDays")), {"_r": "_old", "_f": "Frequency", "_m": "Monetary"}, "CustomerID")
    return out.select(*table.columns, _fifth("_r").alias("R"), _fifth("_f").alias("F"), _fifth("_m").alias("M"))


def segment(r: Column, f: Column) -> Column:
    recent = F.when(f >= 4, "Champions").when(f >= 2, "Potential Loyalist").otherwise("New Customers")
    middle = F.when(f >= 4, "Loyal Customers").when(f >= 2, "Need Attention").otherwise("About to Sleep")
    old = F.when((r == 1) & (f == 5), "Can't Lose Them").when(f >= 4, "At Risk").when(f >= 2, "Hibernating").otherwise("Lost")
    return F.when(r >= 4, recent).when(r == 3, middle).otherwise(old)


def segments(table: DataFrame) -> DataFrame:
    return scores(table).withColumn("Segment", segment(F.col("R"), F.col("F")))


def summary(table: DataFrame) -> DataFrame:
    """Customers, revenue and means of each segment present, unrounded."""
    out = table.groupBy("Segment").agg(F.count("*").alias("Customers"), total("Monetary").alias("Revenue"), (F.sum("RecencyDays") / F.count("*")).alias("AvgRecencyDays"), (F.sum("Frequency") / F.count("*")).alias("AvgFrequency"))
    out = out.withColumn("AvgMonetary", F.col("Revenue") / F.col("Customers"))
    rev = F.col("Revenue").cast("decimal(18,6)")
    return out.withColumn("RevenueShare", F.col("Revenue") / F.sum(rev).over(Window.partitionBy()).cast("double")).withColumn("pos", F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("Segment")).cast("int"))
