"""Exact dedup with a heavy-hitter split, in DataFrame and SQL functions alone.

A Misra-Gries style frequent-items sketch (``approx_top_k``) finds the digests
that may be frequent; an exact count verifies them. The verified winners, a table
of at most ``max_heavy`` rows, are broadcast and settle their copies on the map
side, however many there are. All other digests are shuffled: their groups are
aggregated on the map side first, then joined with the rows, a join that adaptive
execution splits where a group is still large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, read, without, written

#: Rows of the broadcast table; with a digest and three numbers each, 1024 rows are about 0.1 MB.
MAX_HEAVY = 1024
#: Counters of the sketch. A digest with more than about 1/3000 of the rows is found for certain.
COUNTERS = 8192


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY, counters: int = COUNTERS) -> DataFrame:
    """One row for each input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical; of equal texts, the row with the
    largest id stays. A null text counts as empty, so null and empty texts form
    one group. A null id is kept as a row and never wins unless all ids of the
    group are null. Rows repeated with one id are each kept or each dropped.
    An empty table gives an empty result; other input columns are not read.
    """
    rows = written(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256")),
        "digests",
    )
    likely = rows.selectExpr(f"explode(approx_top_k(text_sha256, {int(max_heavy)}, {int(counters)})) AS top").select("top.item", "top.count")
    total = rows.agg(F.count("*").alias("n"))
    # At most max_heavy rows come out of the sketch: a proven bound for both broadcasts.
    likely = likely.join(F.broadcast(total), F.col("count") * (8 * F.lit(max_heavy)) >= F.col("n")).select(F.col("item").alias("text_sha256"))
    heavy = (
        rows.join(F.broadcast(likely), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    heavy = written(heavy, "heavy")
    settled = rows.join(F.broadcast(heavy), "text_sha256")
    rest = rows.join(F.broadcast(heavy), "text_sha256", "left_anti")
    # Of the rest, groups are aggregated first; a join of rows with groups can be split where a window can't.
    groups = rest.groupBy("text_sha256").agg(F.max("doc_id").alias("most"), F.count("*").alias("n")).where("n > 1")
    rest = rest.join(groups, "text_sha256", "left").select("text_sha256", "doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("most")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"))
    return settled.select(rest.columns).unionAll(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are matched by id and digest, so a row that repeats an id with another
    text is judged for itself; rows that repeat both stay or go together.
    """
    out = exact_dedup(docs, id_col, text_col).where("not kept").select("doc_id", "text_sha256").distinct()
    one, two = fresh("id"), fresh("sha")
    gone = written(out.toDF(one, two), "copies")
    return without(docs, gone, id_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), one, two)


def op2_exact_dedup(spark, sf_dir):
    """All documents; null ids and texts and repeated rows as in ``exact_dedup``."""
    return exact_dedup(read(spark, sf_dir, "documents"))
