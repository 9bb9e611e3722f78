"""Customer lifecycle stages and growth accounting by month."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeutil import last_complete_month, month_index, month_label, ratio, total

STAGES = ("new", "retained", "resurrected", "at_risk", "dormant")
ENTRY = "(pre-acquisition)"


@dataclass(frozen=True)
class LifecycleConfig:
    dormancy_months: int = 3

    def __post_init__(self):
        if self.dormancy_months < 1:
            raise ValueError("dormancy_months must be at least 1")


def activity(sales: DataFrame) -> DataFrame:
    """(CustomerID, ym, revenue, last): active complete months of known customers."""
    own = sales.where("CustomerID is not null")
    last = own.agg(last_complete_month(F.max("InvoiceDate")).alias("last"))
    months = own.groupBy("CustomerID", month_index("InvoiceDate").alias("ym")).agg(total("Revenue").alias("revenue"))
    return months.crossJoin(F.broadcast(last)).where("ym <= last")


def coverage(sales: DataFrame) -> DataFrame:
    """Customers scored, and customers seen only after the last complete month."""
    own = sales.where("CustomerID is not null")
    last = own.agg(last_complete_month(F.max("InvoiceDate")).alias("last"))
    per = own.groupBy("CustomerID").agg(F.min(month_index("InvoiceDate")).alias("first")).crossJoin(F.broadcast(last))
    return per.agg(F.count_if(F.col("first") <= F.col("last")).alias("scored"), F.count_if(F.col("first") > F.col("last")).alias("excluded"))


def grid(sales: DataFrame, config: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """One row for each customer and month from the first purchase to the last complete month, with its stage.

    All windows run within a customer, whose rows are at most the months covered.
    """
    months = activity(sales)
    w = Window.partitionBy("CustomerID").orderBy("ym")
    # Each active month fills the months up to the next one, so no join is needed.
    following = F.coalesce(F.lead("ym").over(w) - 1, F.col("last"))
    prev = F.lag("ym").over(w)
    spans = months.select("CustomerID", F.col("ym").alias("active_ym"), "revenue", prev.alias("prev"), following.alias("until"))
    spans = spans.select("CustomerID", "active_ym", "revenue", "prev", F.explode(F.sequence("active_ym", "until")).alias("ym"))
    gap = F.col("ym") - F.col("active_ym")
    stage = (
        F.when((gap == 0) & F.col("prev").isNull(), "new")
        .when((gap == 0) & (F.col("prev") == F.col("ym") - 1), "retained")
        .when(gap == 0, "resurrected")
        .when(gap <= config.dormancy_months, "at_risk")
        .otherwise("dormant")
    )
    return spans.select("CustomerID", "ym", stage.alias("stage"), gap.alias("gap"), F.when(gap == 0, F.col("revenue")).otherwise(0.0).alias("revenue"))


def monthly(cells: DataFrame) -> DataFrame:
    """Growth accounting: counts by stage, churn, quick ratio and revenue by stage."""
    first = cells.agg(F.min("ym").alias("a"), F.max("ym").alias("b")).where("a is not null")
    spine = first.select(F.explode(F.sequence("a", "b")).alias("ym"))
    n = lambda s: F.count_if(F.col("stage") == s).alias(s)
    rev = lambda s: total(F.when(F.col("stage") == s, F.col("revenue")).otherwise(0.0)).alias(f"{s}_revenue")
    sums = cells.groupBy("ym").agg(*[n(s) for s in STAGES], *[rev(s) for s in STAGES[:3]], total("revenue").alias("active_revenue"))
    filled = spine.join(sums, "ym", "left").na.fill(0).na.fill(0.0)
    filled = filled.withColumn("active", F.expr("new + retained + resurrected")).withColumn("base", F.expr("active + at_risk + dormant"))
    w = Window.orderBy("ym")  # one row for each month
    churned = F.lag("active").over(w) - F.col("retained")
    filled = filled.withColumn("churned", churned)
    quick = F.when(F.col("churned") > 0, ratio(F.col("new") + F.col("resurrected"), F.col("churned")))
    return filled.select(month_label("ym").alias("month"), "new", "retained", "resurrected", "active", "churned", quick.alias("quick_ratio"), "at_risk", "dormant", "base", "new_revenue", "retained_revenue", "resurrected_revenue", "active_revenue")


def flows(cells: DataFrame) -> DataFrame:
    """Moves between stages in consecutive months: 6 sources by 5 stages, zeros included.

    The first month of all has no month before it and is left out.
    """
    first = cells.agg(F.min("ym").alias("a"))
    w = Window.partitionBy("CustomerID").orderBy("ym")
    pairs = cells.select("ym", F.coalesce(F.lag("stage").over(w), F.lit(ENTRY)).alias("from"), F.col("stage").alias("to")).crossJoin(F.broadcast(first)).where("ym > a")
    counts = pairs.groupBy("from", "to").agg(F.count("*").alias("n"))
    spark = cells.sparkSession
    every = spark.createDataFrame([(a, b) for a in (ENTRY, *STAGES) for b in STAGES], "`from` string, `to` string")
    return every.join(F.broadcast(counts), ["from", "to"], "left").select("from", "to", F.coalesce("n", F.lit(0)).alias("n"))


def gap_stats(sales: DataFrame, config: LifecycleConfig = LifecycleConfig()) -> DataFrame:
    """Months between consecutive active months of a customer."""
    w = Window.partitionBy("CustomerID").orderBy("ym")
    g = activity(sales).select((F.col("ym") - F.lag("ym").over(w)).alias("g")).where("g is not null")
    p = lambda q: F.percentile("g", F.lit(q))
    return g.agg(F.count("*").alias("n_gaps"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.9).alias("p90"), (F.count_if(F.col("g") <= config.dormancy_months) / F.nullif(F.count("*"), F.lit(0))).alias("share_within_dormancy"))


def headline(table: DataFrame) -> DataFrame:
    """Mean active customers, pooled quick ratio and months with a ratio of at least 1; the first month is left out."""
    w = Window.orderBy("month")
    rest = table.withColumn("rn", F.row_number().over(w)).where("rn > 1")
    return rest.agg(F.count("*").alias("months"), (F.sum("active") / F.nullif(F.count("*"), F.lit(0))).alias("mean_active"), ratio(F.sum(F.col("new") + F.col("resurrected")), F.sum("churned")).alias("pooled_quick_ratio"), F.count_if(F.col("quick_ratio") >= 1).alias("months_at_least_1"))
