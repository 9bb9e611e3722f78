"""Reading and writing transaction lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workbook import read_workbook

COLUMNS = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "CustomerID", "Country", "SourceSheet"]
TEXT = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])


def typed(df: DataFrame) -> DataFrame:
    """Cast raw text columns to their types; what does not parse becomes null.

    A quantity that does not parse fails the job: it is never null. Columns that
    are absent are added as null, and "Customer ID" is renamed.
    """
    if "Customer ID" in df.columns:
        df = df.withColumnRenamed("Customer ID", "CustomerID")
    for c in COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    quantity = F.expr("try_cast(try_cast(Quantity AS double) AS bigint)")
    price = F.expr("try_cast(Price AS double)")
    return df.select(
        F.coalesce(F.col("Invoice").cast("string"), F.lit("nan")).alias("Invoice"),
        F.coalesce(F.col("StockCode").cast("string"), F.lit("nan")).alias("StockCode"),
        F.col("Description").cast("string").alias("Description"),
        F.coalesce(quantity, F.raise_error(F.concat(F.lit("not a quantity: "), F.coalesce(F.col("Quantity").cast("string"), F.lit("null")))).cast("bigint")).alias("Quantity"),
        F.expr("try_cast(InvoiceDate AS timestamp)").alias("InvoiceDate"),
        F.when(~F.isnan(price), price).alias("Price"),
        F.expr("try_cast(try_cast(CustomerID AS double) AS bigint)").alias("CustomerID"),
        F.coalesce(F.col("Country").cast("string"), F.lit("nan")).alias("Country"),
        F.col("SourceSheet").cast("string").alias("SourceSheet"),
    )


def load_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of Parquet files, CSV files (``.csv``, ``.csv.gz``) or workbooks (``.xlsx``), joined by column name.

    A workbook's sheets name their lines' SourceSheet; of other files, each file's
    name is its SourceSheet where it has none. Files that do not
    exist raise Spark's own error with the path.
    """
    out = None
    for path in paths:
        if path.rstrip("/").endswith((".csv", ".csv.gz")):
            part = spark.read.option("header", True).csv(path)
        elif path.endswith(".xlsx"):
            part = read_workbook(spark, path)
        else:
            part = spark.read.parquet(path)
        if "SourceSheet" not in part.columns:
            part = part.withColumn("SourceSheet", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
        part = typed(part)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError("no path given: name at least one Parquet or CSV file of transaction lines")
    return out


def write_workbook(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Named result tables as folders of Parquet files; empty ones are left out."""
    made = []
    for name, df in tables.items():
        if df is not None and df.take(1):
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            made.append(name)
    return made


def sample_lines(df: DataFrame, share: float, seed: int = 42, *strata: str) -> DataFrame:
    """A repeatable sample of about ``share`` of each stratum; each stratum keeps one row at least.

    Rows are chosen by their hash; of a stratum in which none falls below the
    share, the rows of least hash stay. Equal rows stay or go together.
    """
    spread = F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in df.columns])
    rows = df.withColumn("_u", F.pmod(spread, F.lit(1 << 40)))
    below = F.col("_u") < int(share * (1 << 40))
    if not strata:
        return rows.where(below).drop("_u")
    keys = [F.col(c).alias(f"_s{i}") for i, c in enumerate(strata)]
    least = rows.groupBy(*keys).agg(F.min("_u").alias("_least"))
    same = [F.col(c).eqNullSafe(F.col(f"_s{i}")) for i, c in enumerate(strata)]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return rows.join(least, on).where(below | (F.col("_u") == F.col("_least"))).select(*df.columns)


def sample_strata(df: DataFrame, strata: dict[str, tuple[Column, int]], copies: tuple[list[str], int] | None = None, seed: int = 42) -> DataFrame:
    """A repeatable sample with exact sizes: of each stratum (condition, k) the k rows of least hash, or all where there are fewer.

    A bottom-k is mergeable: every task keeps k rows, and so does their merge. With
    ``copies`` (columns, k), all rows of k groups that are equal in these columns
    and have at least two rows are added, the groups of least hash. A row that is
    in several strata comes once for each, as drawn; nothing depends on the order
    or partitions of the input.
    """
    spread = lambda names: F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in names])
    out = None
    for name, (condition, k) in strata.items():
        order = F.xxhash64(F.lit(name), spread(df.columns))  # each stratum draws for itself
        part = df.where(condition).withColumn("_u", order).orderBy("_u", *[F.col(c).cast("string") for c in df.columns]).limit(k).drop("_u")
        out = part if out is None else out.unionAll(part)
    if copies is not None:
        names, k = copies
        groups = df.groupBy(*names).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_u", spread(names)).orderBy("_u", *[F.col(c).cast("string") for c in names]).limit(k)
        keys = groups.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)])  # k rows
        same = F.lit(True)
        for i, c in enumerate(names):
            same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
        part = df.join(F.broadcast(keys), same, "left_semi")
        out = part if out is None else out.unionAll(part)
    return df.limit(0) if out is None else out


def fixture(df: DataFrame, share: float = 1.0, seed: int = 42) -> DataFrame:
    """A small table with every mess that cleaning removes: random lines, cancellations, codes that are no products, prices of zero or less, and whole groups of copies.

    The sizes are those of a 2,000-row fixture times ``share``.
    """
    from ..operators import cleaning

    size = lambda n: max(1, round(n * share))
    strata = {
        "random": (F.lit(True), size(1600)), "cancellations": (cleaning.is_cancellation(F.col("Invoice")), size(150)),
        "non_product": (cleaning.is_non_product(F.col("StockCode")), size(100)), "zero_price": (F.col("Price") <= 0, size(60)),
    }
    return sample_strata(df.select(*cleaning.KEY), strata, (list(cleaning.KEY), size(20)), seed)
