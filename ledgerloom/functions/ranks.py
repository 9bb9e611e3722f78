"""Global ranks, exact percentiles and crossings of running sums, each in one range-partitioned pass.

Rows are dealt by range of (value, key) and sorted inside each partition; a row's
number there and the counts of the partitions before give its rank. The dealt rows
are written once, as counts and ranks must see the same partitions. Equal values
are told apart by the key, so no value, however frequent, makes a partition large.
What is broadcast has a row for each partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import hold


def _dealt(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` in global order: ``_part`` is the partition, ``_at`` grows with the order inside it."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = hold(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    return held.withColumn("_part", F.shiftright("_at", 33).cast("int"))  # how that function numbers partitions


def _before(dealt: DataFrame, by: list[str], amount: Column) -> DataFrame:
    """For each partition (of each group of ``by``): its least ``_at``, the amount before it, its own and that of all."""
    parts = dealt.groupBy(*by, "_part").agg(F.min("_at").alias("_least"), F.sum(amount).alias("_own"))
    behind = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("*", F.coalesce(F.sum("_own").over(behind), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy(*by)).alias("_all"))


def ranked(rows: DataFrame, by: dict[str, str], key: str) -> DataFrame:
    """``rows`` with a rank from 1 for each entry (name of the rank: column, ascending, nulls first) of ``by``, and the number of rows ``n``.

    ``key`` is unique and settles ties. Several ranks are made in one pass: each
    row gives a row for each, compared as doubles, and they meet again by key.
    """
    rank = (F.col("_before") + F.col("_at") - F.col("_least") + 1).cast("long")
    if len(by) == 1:
        ((name, column),) = by.items()
        dealt = _dealt(rows, column, key)
        out = dealt.join(F.broadcast(_before(dealt, [], F.lit(1))), "_part")
        return out.select(*rows.columns, rank.alias(name), F.col("_all").cast("long").alias("n"))
    rest = F.struct(*[c for c in rows.columns if c != key])
    kind = rows.select(rest.alias("r")).schema["r"].dataType.simpleString()
    array = F.array(*[F.struct(F.lit(i).alias("_no"), F.col(c).cast("double").alias("_v"), (rest if i == 0 else F.lit(None)).cast(kind).alias("_rest")) for i, c in enumerate(by.values())])
    dealt = _dealt(rows.select(key, F.explode(array).alias("_x")).select(key, "_x.*"), "_no", "_v", key)
    out = dealt.join(F.broadcast(_before(dealt, ["_no"], F.lit(1))), ["_no", "_part"])
    ranks = [F.max(F.when(F.col("_no") == i, rank)).alias(name) for i, name in enumerate(by)]
    out = out.groupBy(key).agg(F.first("_rest", ignorenulls=True).alias("_rest"), *ranks, F.max("_all").cast("long").alias("n"))
    return out.select(*[F.col(c) if c == key else F.col(f"_rest.{c}").alias(c) for c in rows.columns], *by, "n")


def percentiles(rows: DataFrame, columns: list[Column], at: list[float]) -> DataFrame:
    """One row with the exact percentiles (linear between neighbours) of each column: arrays ``q0``, ``q1``, ... and numbers of values ``n0``, ...

    All columns share one count of their values and one pass; a repeated value is
    one row. Running counts are made only in the partitions that hold a place
    asked for. An array is null where there are no values.
    """
    values = F.array(*[F.struct(F.lit(i).alias("_no"), c.cast("double").alias("_v")) for i, c in enumerate(columns)])
    counts = rows.select(F.explode(values).alias("_x")).select("_x.*").where("_v is not null").groupBy("_no", "_v").agg(F.count("*").alias("_c"))
    dealt = _dealt(counts, "_no", "_v")
    parts = hold(_before(dealt, ["_no"], F.col("_c")), "parts")
    asked = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(up).alias("_up"), (F.ceil if up else F.floor)(F.lit(p) * (F.col("_all") - 1)).alias("_place")) for i, p in enumerate(at) for up in (False, True)])
    # Two places for each percentile and column, each in one partition.
    hit = parts.select("*", F.explode(asked).alias("_y")).select("*", "_y.*").where("_place >= _before AND _place < _before + _own")
    along = Window.partitionBy("_no", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.join(F.broadcast(hit.select("_no", "_part", "_before").distinct()), ["_no", "_part"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(along))
    found = near.drop("_before").join(F.broadcast(hit.select("_no", "_part", "_i", "_up", "_place", "_all")), ["_no", "_part"]).where("_place < _upto AND _place >= _upto - _c")
    p = F.element_at(F.array(*[F.lit(x) for x in at]), F.col("_i") + 1)
    low, high = F.max(F.when(~F.col("_up"), F.col("_v"))), F.max(F.when(F.col("_up"), F.col("_v")))
    share = F.max(p * (F.col("_all") - 1) - F.floor(p * (F.col("_all") - 1)))
    each = found.groupBy("_no", "_i").agg((low + (high - low) * share).alias("_q"), F.max("_all").alias("_all"))
    return each.agg(*[e for k in range(len(columns)) for e in (_array_of(k, len(at)).alias(f"q{k}"), F.coalesce(F.max(F.when(F.col("_no") == k, F.col("_all"))), F.lit(0)).cast("long").alias(f"n{k}"))])


def _array_of(k: int, many: int) -> Column:
    values = [F.max(F.when((F.col("_no") == k) & (F.col("_i") == i), F.col("_q"))) for i in range(many)]
    return F.when(values[0].isNotNull(), F.array(*values))


def reaching(rows: DataFrame, by: str, key: str, amount: str, share: float) -> DataFrame:
    """One row: after how many rows, in ascending order of ``by``, the running sum of ``amount`` first makes up ``share`` of all (``reach``), with ``all`` and ``n``.

    ``reach`` is null where the sum of all is not positive. Amounts are decimals
    and not negative. Running sums are made only in the partition where the share
    is crossed.
    """
    dealt = _dealt(rows.select(by, key, amount), by, key)
    sums, counts = _before(dealt, [], F.col(amount)), _before(dealt, [], F.lit(1))
    parts = hold(sums.join(counts.select("_part", F.col("_before").alias("_rows"), F.col("_all").alias("_n")), "_part"), "parts")
    over = lambda x: x.cast("double") / F.col("_all").cast("double") >= share
    here = parts.where("_all > 0").where(over(F.col("_before") + F.col("_own"))).agg(F.min("_part").alias("_part"))
    along = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    near = dealt.join(F.broadcast(here), "_part").withColumn("_sum", F.sum(amount).over(along)).join(F.broadcast(parts), "_part")
    first = near.where(over(F.col("_before") + F.col("_sum"))).agg(F.min(F.col("_rows") + F.col("_at") - F.col("_least") + 1).cast("long").alias("reach"))
    return first.crossJoin(F.broadcast(parts.agg(F.max("_all").alias("all"), F.coalesce(F.max("_n"), F.lit(0)).cast("long").alias("n"))))
