"""Resharding by minimum-cost flow: fewest bytes moved between old and new shards.

Rows with equal texts form a group; a group stays in one shard unless it alone is
larger than a shard, in which case its rows are dealt over as many pieces as that
takes. Groups are gathered in blocks by the hash of their text: ``blocks`` blocks
for each old shard, and each heavy group is a block of its own. Only block totals
(a number fixed by the parameters, whatever the input) reach the driver. There a
transport problem is solved as minimum-cost flow: supply is an old shard's bytes,
demand a new shard's capacity, keeping bytes where they are costs nothing and
moving them costs 1. The flow is then realised with whole blocks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_hash, place_of_null, read, written
from .flow import MinCostFlow

SEED = 0x5EED


def plan_moves(sizes: dict[int, int], blocks: list[tuple[int, int, int]], n_new: int) -> dict[tuple[int, int], int]:
    """New shard of each block.

    ``sizes``: bytes of each old shard; ``blocks``: (old shard, block, bytes).
    Old shard k and new shard k are the same place for k < n_new. Returns
    {(old shard, block): new shard}.
    """
    total = sum(sizes.values())
    olds = sorted(sizes)
    cap = [total // n_new + (k < total % n_new) for k in range(n_new)]
    net = MinCostFlow(len(olds) + n_new + 2)
    s, t = len(olds) + n_new, len(olds) + n_new + 1
    arcs = {}
    for i, old in enumerate(olds):
        net.add(s, i, sizes[old], 0)
        for k in range(n_new):
            arcs[old, k] = net.add(i, len(olds) + k, sizes[old], int(old != k))
    for k in range(n_new):
        net.add(len(olds) + k, t, cap[k], 0)
    net.solve(s, t)
    room = list(cap)
    out: dict[tuple[int, int], int] = {}
    for old in olds:
        own = sorted((b for b in blocks if b[0] == old), key=lambda b: (-b[2], b[1]))
        due = {k: net.flow(arcs[old, k]) for k in range(n_new)}
        for _, block, size in own:
            # Largest block first, to the flow with most bytes still due; ties stay in place.
            k = max(due, key=lambda k: (due[k], k == old, -k))
            out[old, block] = k
            due[k] -= size
            room[k] -= size
    # Whole blocks leave small errors; mend them with blocks that need not leave home where there are such.
    place = {(b[0], b[1]): b[2] for b in blocks}
    for _ in range(4 * len(blocks)):
        low, high = min(range(n_new), key=lambda k: (room[k], k)), max(range(n_new), key=lambda k: (room[k], -k))
        gap = room[high] - room[low]
        fit = [(b[0] == low, b[0] != high, abs(place[b] - gap / 2), b) for b, k in out.items() if k == low and 0 < place[b] < gap]
        if not fit or gap * 500 < total // n_new:
            break
        b = min(fit)[3]
        out[b] = high
        room[low] += place[b]
        room[high] -= place[b]
    # Blocks that may go home without more imbalance than there is go home.
    least, most = min(room), max(room)
    for b in sorted((b for b, k in out.items() if b[0] < n_new and k != b[0]), key=lambda b: (-place[b], b)):
        k = out[b]
        if room[b[0]] - place[b] >= least and room[k] + place[b] <= most:
            room[b[0]] -= place[b]
            room[k] += place[b]
            out[b] = b[0]
    return out


def reshard(
    docs: DataFrame,
    n_old: int = 12,
    n_new: int = 16,
    blocks: int = 256,
    chunks: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    old_shard: str | None = None,
) -> DataFrame:
    """One row for each input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved.

    ``size`` is the UTF-8 length of the text (null: none) plus 1, ``text_crc32``
    that of its bytes (null: of none, 0). ``old_shard`` names a column with the
    present shard; without one, the old layout is the text's hash modulo
    ``n_old``. Slots are gapless from 0 in each shard, in an order fixed by the
    id. Null ids are rows like others, spread by their place in the table, which
    also decides their slots; repeated rows each get a slot. Null and empty texts
    are one group. An empty table gives an empty result. The law
    kept is ``bytes``: shards differ by about a block, unless one group makes
    that impossible. ``grown_shard`` belongs to another law and is null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.xxhash64(text, F.crc32(F.encode(text, "UTF-8")))
    old = F.pmod(F.col("group"), F.lit(n_old)).cast("int") if old_shard is None else F.col("present").cast("int")
    picked = [F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("bytes"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), digest.alias("group")]
    if old_shard is not None:
        picked.append(F.col(old_shard).alias("present"))
    rows = docs.select(*picked).withColumn("size", F.col("bytes") + 1).withColumn("old_shard", old).drop("present", "bytes")
    rows = rows.withColumn("place", place_of_null("doc_id"))
    rows = written(rows, "reshard-rows")
    total = rows.agg(F.sum("size")).first()[0]
    spark = docs.sparkSession
    if total is None:
        return rows.select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", F.lit(False).alias("moved")
        )
    capacity = max(1, total // n_new)
    # Heavy groups: over 1/64 of a shard. There are fewer than 64 * n_new of them for each old shard.
    heavy = rows.groupBy("group", "old_shard").agg(F.sum("size").alias("group_bytes")).where(F.col("group_bytes") * 64 > capacity)
    heavy = heavy.withColumn("pieces", F.when(F.col("group_bytes") > capacity, F.ceil(8 * F.col("group_bytes") / F.lit(capacity))).otherwise(1).cast("int"))
    heavy = written(heavy, "reshard-heavy")
    rows = rows.join(F.broadcast(heavy), ["group", "old_shard"], "left")
    piece = F.pmod(doc_hash("doc_id", "place", seed=SEED), F.col("pieces"))
    block = F.when(F.col("pieces").isNull(), F.pmod(F.shiftright("group", 8), F.lit(blocks)).cast("string")).otherwise(F.concat_ws(":", F.col("group").cast("string"), piece.cast("string")))
    rows = rows.withColumn("block", block)
    sums = [(r[0], r[1], r[2]) for r in rows.groupBy("old_shard", "block").agg(F.sum("size")).collect()]
    sizes: dict[int, int] = {}
    for o, _, n in sums:
        sizes[o] = sizes.get(o, 0) + n
    moves = plan_moves(sizes, sums, n_new)
    table = spark.createDataFrame([(o, b, k) for (o, b), k in sorted(moves.items())], "old_shard int, block string, shard int")
    rows = rows.join(F.broadcast(table), ["old_shard", "block"])
    rows = rows.withColumn("chunk", F.pmod(doc_hash("doc_id", "group", "place", seed=SEED + 1), F.lit(chunks)).cast("int"))
    # n_new * chunks rows at most: cumulative counts turn a rank in a chunk into a slot.
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size")
    rows = rows.withColumn("rank", F.row_number().over(order)).join(F.broadcast(counts), ["shard", "chunk"])
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
        (F.col("shard") != F.col("old_shard")).alias("moved"),
    )


def _files(spark, path: str):
    """Hadoop's file system of a path, and what makes its paths."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def finish(spark, path: str) -> None:
    """Put new shards that a rewrite had written whole in their place; drop what one that broke off had written.

    Renames and deletions alone, each of which can be done again.
    """
    fs, of = _files(spark, path)
    for found in fs.listStatus(of(path)):
        at = found.getPath().toString()
        if "/_reshard-" not in at:
            continue
        if fs.exists(of(f"{at}/ready")):
            for new in fs.listStatus(of(f"{at}/new")):
                name = new.getPath().getName()
                if name.startswith("shard="):
                    fs.delete(of(f"{path}/{name}"), True)
                    if not fs.rename(new.getPath(), of(f"{path}/{name}")):
                        raise OSError(f"{name} can't be put in its place")
            for gone in fs.listStatus(of(f"{at}/emptied")):
                fs.delete(of(f"{path}/{gone.getPath().getName()}"), True)
        fs.delete(of(at), True)


def rewrite(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write only the shards whose rows change, as ``path/shard=K``, each in as many files as its rows need.

    ``docs`` is the table stored under ``path`` partitioned by shard, with unique
    non-null ids; ``plan`` comes from ``reshard(docs, old_shard="shard", ...)``.
    Shards that neither lose nor gain a row keep their files. New shards are
    written whole beside the old ones first; a run that fails until then leaves the
    table as it was, and one that fails while they are put in place is completed by
    ``finish``, which must come before another rewrite.
    """
    spark = docs.sparkSession
    fs, of = _files(spark, path)
    if any(fs.exists(of(f"{f.getPath().toString()}/ready")) for f in fs.listStatus(of(path))):
        raise RuntimeError(f"a rewrite of {path} broke off; finish(spark, path) completes it, and then the table must be read again")
    moved = plan.where("moved")
    touched = moved.select("shard").union(moved.select("old_shard")).distinct()
    new = plan.join(F.broadcast(touched), "shard", "left_semi").select(F.col("doc_id").alias(id_col), "shard", "slot")
    emptied = touched.join(new.select("shard").distinct(), "shard", "left_anti").collect()
    at = f"{path}/_reshard-{uuid.uuid4().hex}"
    out = docs.drop("shard", "slot").join(new, id_col)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{at}/new")
    fs.mkdirs(of(f"{at}/emptied"))
    for row in emptied:
        fs.mkdirs(of(f"{at}/emptied/shard={row[0]}"))
    fs.create(of(f"{at}/ready"), True).close()
    finish(spark, path)


def op7_resharding(spark, sf_dir):
    """All documents by the law of equal bytes; null ids and texts and equal texts as in ``reshard``."""
    return reshard(read(spark, sf_dir, "documents"))
