"""Market baskets: frequent itemsets level by level, and rules."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from ..functions.timeutil import ratio, total
from ..sources.scratch import hold


@dataclass(frozen=True)
class BasketConfig:
    top_items: int = 200
    min_items: int = 2
    min_support: float = 0.01
    max_len: int = 3
    min_confidence: float = 0.30
    min_lift: float = 1.10
    thin_count: int = 30

    def __post_init__(self):
        for ok, what in (
            (self.top_items >= 2, "top_items must be at least 2"),
            (self.min_items >= 2, "min_items must be at least 2"),
            (0 < self.min_support <= 1, "min_support must be in (0, 1]"),
            (self.max_len in (2, 3), "max_len must be 2 or 3"),
            (0 < self.min_confidence <= 1, "min_confidence must be in (0, 1]"),
            (self.min_lift >= 1, "min_lift must be at least 1"),
            (self.thin_count >= 1, "thin_count must be positive"),
        ):
            if not ok:
                raise ValueError(what)


def min_count(support: float, n: int) -> int:
    """Least count whose share of n is at least ``support``."""
    return max(1, math.ceil(support * n - 1e-9))


def normalized(column: str):
    return F.regexp_replace(F.trim(F.upper(F.col(column))), r"\s+", " ")


def catalog(sales: DataFrame, top: int) -> DataFrame:
    """(StockCode, Item): the leading codes by revenue and their most frequent description.

    Null and blank descriptions are absent. Ties go to the smaller code and text.
    """
    lines = sales.select("StockCode", normalized("Description").alias("Item"), "Revenue").where("length(Item) > 0")
    best = lines.groupBy("StockCode").agg(total("Revenue").alias("r")).orderBy(F.desc("r"), "StockCode").limit(top)
    counts = lines.groupBy("StockCode", "Item").agg(F.count("*").alias("n"))
    modal = counts.groupBy("StockCode").agg(F.min_by("Item", F.struct(-F.col("n"), F.col("Item"))).alias("Item"))
    return modal.join(best, "StockCode", "left_semi")


def all_items(sales: DataFrame, items: DataFrame) -> DataFrame:
    """(Invoice, Item) distinct, of the tracked codes."""
    return sales.join(items, "StockCode").select("Invoice", "Item").distinct()


def baskets(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(Invoice, Item) of invoices with at least ``least`` items."""
    return pairs.withColumn("n", F.count("*").over(Window.partitionBy("Invoice"))).where(F.col("n") >= least).select("Invoice", "Item")


def survivors(sales: DataFrame, items: DataFrame, least: int = 2) -> DataFrame:
    per = all_items(sales, items).groupBy("Invoice").agg(F.count("*").alias("n"))
    kept = per.agg(F.count("*").alias("invoices_with_tracked_item"), F.count_if(F.col("n") >= least).alias("baskets_mined"), ratio(F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n"))), F.lit(0)), F.count_if(F.col("n") >= least)).alias("m"))
    return sales.agg(F.count_distinct("Invoice").alias("invoices_total")).crossJoin(kept).crossJoin(items.agg(F.count("*").alias("stock_codes_tracked"), F.count_distinct("Item").alias("items_after_description_merge"))).withColumn("mean_basket_size", F.coalesce("m", F.lit(0.0))).drop("m")


#: Baskets in a block of the vertical form; Spark's bitmaps have as many bits.
BLOCK = 32_768


def vertical(pairs: DataFrame) -> DataFrame:
    """(block, Item, bits): in which baskets of each block of 32,768 an item is, as a bitmap of 4 KB.

    Baskets are numbered by the rank of their invoice.
    """
    numbered = ranked(pairs.select("Invoice").distinct(), {"basket": "Invoice"}, "Invoice").select("Invoice", "basket")
    rows = pairs.join(numbered, "Invoice")
    return rows.groupBy(F.expr("bitmap_bucket_number(basket)").alias("block"), "Item").agg(F.expr("bitmap_construct_agg(bitmap_bit_position(basket))").alias("bits"))


def _supports(blocks: DataFrame, candidates: list[tuple[str, ...]]) -> DataFrame:
    """(items, count) of the candidates, sets of items in order: bitmaps of a block are intersected and counted in its task, counts are summed over blocks.

    The candidates are sets of tracked items; their number is bounded by those, not by baskets.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = {item: np.frombuffer(b, np.uint64) for item, b in zip(pdf["Item"], pdf["bits"])}
        lead: dict[tuple[str, ...], np.ndarray | None] = {(): None}

        def common(items: tuple[str, ...]) -> np.ndarray | None:
            """The baskets of all items; those of all but the last are kept, as candidates come in order."""
            if len(items) == 1:
                return bits.get(items[0])
            if items[:-1] not in lead:
                lead.clear()
                lead[items[:-1]] = common(items[:-1])
            a, b = lead[items[:-1]], bits.get(items[-1])
            return None if a is None or b is None else a & b

        found = [(list(c), int(np.bitwise_count(x).sum())) for c in candidates if (x := common(c)) is not None]
        return pd.DataFrame([f for f in found if f[1]], columns=["items", "count"])

    each = blocks.groupBy("block").applyInPandas(run, "items array<string>, count long")
    return each.groupBy("items").agg(F.sum("count").alias("count"))


def itemsets(pairs: DataFrame, config: BasketConfig = BasketConfig()) -> tuple[DataFrame, int]:
    """(size, a, b, c, count, support) of all frequent itemsets, and the number of baskets.

    Level by level on vertical bitmaps: a set's baskets are the intersection of its
    items' bitmaps. No basket is joined with itself, so the work grows with
    candidates and blocks of baskets, not with the square of a basket. A level's
    candidates are those whose subsets are all frequent; they and the frequent sets
    are bounded by the tracked items and held on the driver.
    """
    spark = pairs.sparkSession
    pairs = hold(pairs, "pairs")  # read for the numbers of baskets, the bitmaps and the count
    blocks = hold(vertical(pairs), "baskets")
    n = pairs.select(F.count_distinct("Invoice")).first()[0]
    least = min_count(config.min_support, n)
    one = blocks.groupBy("Item").agg(F.sum(F.expr("bitmap_count(bits)")).alias("count")).where(F.col("count") >= least).collect()
    found: dict[tuple[str, ...], int] = {(r["Item"],): r["count"] for r in one}
    level = sorted(found)
    for size in range(2, config.max_len + 1):
        joined = [(*x, y[-1]) for i, x in enumerate(level) for y in level[i + 1 :] if x[:-1] == y[:-1]]
        candidates = [c for c in joined if all(s in found for s in combinations(c, size - 1))]
        if not candidates:
            break
        got = _supports(blocks, candidates).where(F.col("count") >= least).collect()
        found |= {tuple(r["items"]): r["count"] for r in got}
        level = sorted(tuple(r["items"]) for r in got)
    rows = [(len(s), *s, *[None] * (3 - len(s)), c, c / max(n, 1)) for s, c in sorted(found.items())]
    return spark.createDataFrame(rows, "size int, a string, b string, c string, count long, support double"), n


def rules(sets: DataFrame, n: int, config: BasketConfig = BasketConfig()) -> DataFrame:
    """All splits of all itemsets into antecedent and consequent that pass confidence and lift."""
    keyed = sets.select(F.array_compact(F.array("a", "b", "c")).alias("items"), "size", "count")
    splits = []
    for size in (2, 3):
        for k in range(1, size):
            for left in combinations(range(size), k):
                right = [i for i in range(size) if i not in left]
                splits.append(F.when(F.col("size") == size, F.struct(F.array(*[F.get("items", i) for i in left]).alias("x"), F.array(*[F.get("items", i) for i in right]).alias("y"))))
    every = keyed.where("size > 1").select("items", "count", F.explode(F.array_compact(F.array(*splits))).alias("s")).select("items", "count", "s.x", "s.y")
    px, py = keyed.select(F.col("items").alias("x"), F.col("count").alias("nx")), keyed.select(F.col("items").alias("y"), F.col("count").alias("ny"))
    total_n = F.lit(float(max(n, 1)))
    scored = every.join(px, "x").join(py, "y")
    s, sx, sy = F.col("count") / total_n, F.col("nx") / total_n, F.col("ny") / total_n
    scored = scored.withColumns({"support": s, "sx": sx, "sy": sy}).withColumn("confidence", F.col("support") / F.col("sx"))
    scored = scored.withColumn("lift", F.col("confidence") / F.col("sy")).withColumn("leverage", F.col("support") - F.col("sx") * F.col("sy"))
    conviction = F.when(F.col("confidence") < 1, (1 - F.col("sy")) / (1 - F.col("confidence"))).otherwise(F.lit(float("inf")))
    out = scored.where((F.col("confidence") >= config.min_confidence) & (F.col("lift") >= config.min_lift))
    return out.select(F.array_join("x", " + ").alias("antecedent"), F.array_join("y", " + ").alias("consequent"), F.array_join("items", " + ").alias("itemset"), "support", "confidence", "lift", "leverage", conviction.alias("conviction"), F.col("count").alias("support_count"), (F.col("count") < config.thin_count).alias("thin_support"))


def first_by_itemset(found: DataFrame) -> DataFrame:
    """The best direction of each itemset: by lift, confidence, then texts."""
    w = Window.partitionBy("itemset").orderBy(F.desc("lift"), F.desc("confidence"), "antecedent", "consequent")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def fp_growth(pairs: DataFrame, n: int, config: BasketConfig = BasketConfig()) -> DataFrame:
    """The same itemsets by MLlib's FP-growth, as a cross-check."""
    from pyspark.ml.fpm import FPGrowth

    wide = pairs.groupBy("Invoice").agg(F.collect_set("Item").alias("items"))
    least = min_count(config.min_support, n)
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / max(n, 1), minConfidence=1.0).fit(wide)
    s = F.sort_array("items")
    return model.freqItemsets.where(F.size("items") <= config.max_len).select(F.size("items").alias("size"), F.get(s, 0).alias("a"), F.get(s, 1).alias("b"), F.get(s, 2).alias("c"), F.col("freq").alias("count"))
