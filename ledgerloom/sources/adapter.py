"""Transaction lines made from the star schema of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines: returned items are cancellations; every mess that cleaning removes occurs.

    Small dimension tables are left to Catalyst, which broadcasts those whose size
    is known to be small and shuffles the others.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    returned = F.col("l_returnflag") == "R"
    nth = lambda n: F.col("l_orderkey") % n == 0
    lines = (
        t("lineitem")
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("part").select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("customer").select("c_custkey", "c_nationkey", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    rung = (F.lit(10) + F.substring("p_brand", 7, 10).cast("int")) * (1 - F.col("l_discount"))
    lines = lines.select(
        F.concat(F.when(returned, "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("Invoice"),
        F.when(nth(89), "POST").when(nth(83), "gift_0001_10").otherwise(F.col("p_brand")).alias("StockCode"),
        F.when(~nth(71), F.col("p_name")).alias("Description"),
        (F.col("l_quantity").cast("long") * F.when(returned | nth(73), -1).otherwise(1)).cast("long").alias("Quantity"),
        F.when(returned, F.col("l_shipdate")).otherwise(F.col("o_orderdate")).cast("timestamp").alias("InvoiceDate"),
        F.when(nth(79), F.lit(0.0)).otherwise(F.round(rung, 2)).alias("Price"),
        F.when(F.col("c_acctbal") >= 0, F.col("o_custkey")).cast("long").alias("CustomerID"),
        F.col("n_name").alias("Country"),
        F.explode(F.when(nth(97), F.array(F.lit("first"), F.lit("again"))).otherwise(F.array(F.lit("first")))).alias("SourceSheet"),
    )
    return lines
