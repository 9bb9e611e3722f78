"""Mixing sources to target weights by minimum-cost flow.

Documents are aggregated by membership pattern (the sorted set of sources they
belong to). Each pattern may be used up to ``repeats`` times over; the n-th use
of a word costs n - 1, so costs are convex and repetition is used only where a
quota needs it. Flow routes each pattern's words to the quotas of its sources.
Documents are then selected by a seeded hash: each is taken the whole number of
times that the flow covers its pattern, and once more if its hash lies below the
pattern's cut, which is found by refining a histogram of hashes. What the last
document was too large for is filled with smaller ones in further rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_hash, fresh, read, written
from .flow import MinCostFlow

SEED = 20_240_601
WEIGHTS = (5, 2, 1)
REPEATS = 3
_BITS = 12


def targets_of(sizes: dict, weights=WEIGHTS, repeats: int = REPEATS) -> dict:
    """Target words of each source.

    Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
    all words; a target stops at ``repeats`` times its source's words and the
    excess is shared again by weight until none is above.
    """
    names = sorted(sizes, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out: dict = {}
    left, free = float(sum(sizes.values())), list(names)
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > repeats * sizes[s]]
        if not over:
            return out | {s: weight[s] * share for s in free}
        for s in over:
            out[s] = float(repeats * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def _whole(targets: dict) -> dict:
    """Targets as integers with the same sum, by largest remainder."""
    total = round(sum(targets.values()))
    out = {s: int(t) for s, t in targets.items()}
    order = sorted(targets, key=lambda s: (out[s] - targets[s], s is None, s or ""))
    for s in order[: max(0, total - sum(out.values()))]:
        out[s] += 1
    return out


def route(patterns: dict[tuple, int], quotas: dict, repeats: int = REPEATS) -> dict[tuple, int]:
    """Words to take of each pattern, repeats counted."""
    keys, names = sorted(patterns, key=repr), sorted(quotas, key=repr)
    net = MinCostFlow(len(keys) + len(names) + 2)
    s, t = len(keys) + len(names), len(keys) + len(names) + 1
    used = {p: [net.add(s, i, patterns[p], n) for n in range(repeats)] for i, p in enumerate(keys)}
    for i, p in enumerate(keys):
        for name in p:
            net.add(i, len(keys) + names.index(name), repeats * patterns[p], 0)
    for j, name in enumerate(names):
        net.add(len(keys) + j, t, quotas[name], 0)
    net.solve(s, t)
    return {p: sum(net.flow(k) for k in arcs) for p, arcs in used.items()}


def mix(docs: DataFrame, memberships: str = "sources", weights=WEIGHTS, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, dict, dict]:
    """A mix: (rows, source sizes, targets).

    ``memberships`` is an array column of source names (null is a source of its
    own; an empty array is never taken). The rows are doc_id, size, pattern,
    copies (0 to ``repeats``) and the columns ``keep`` in a struct ``row``. Size is
    the word count of the text (null: 0); rows without words are never taken.
    Sources and patterns are nodes of the flow, so they must fit on the driver, a
    number of each; documents never go there. Rows with a null or repeated id are
    told apart by their texts, and equal rows are numbered where only some of them
    are taken. Very long texts count whole. An empty table gives an empty result.
    """
    words, pattern = _size(text_col) if size is None else size, _pattern(F.col(memberships))
    columns = [F.col(id_col).alias("doc_id"), words.alias("size"), pattern.alias("pattern"), _spread(F.col(id_col), F.col(text_col), seed).alias("_hash")]
    rows = written(docs.select(*columns), "mix-rows")
    totals = {r[0]: r[1] for r in rows.groupBy("pattern").agg(F.sum("size")).collect()}
    members = {p: tuple(None if s == "\x00" else s[1:] for s in p.split("\x01")) if p else () for p in totals}
    sizes: dict = {}
    for p, n in totals.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    targets = targets_of(sizes, weights, repeats)
    flows = route({members[p]: n for p, n in totals.items() if members[p]}, _whole(targets), repeats)
    base, want = {}, {}
    for p, n in totals.items():
        got = flows.get(members[p], 0)
        base[p] = min(repeats, got // n) if n else 0
        want[p] = got - base[p] * n if n and base[p] < repeats else 0
    # Rows that keep other columns are read again rather than written with them.
    all_of = docs.select(*columns, F.struct(*[F.col(c) for c in keep]).alias("row")) if keep else rows
    return _chosen(rows, all_of, base, want), sizes, targets


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _pattern(members: Column) -> Column:
    none = F.lit("\x00")
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(members, lambda s: F.coalesce(F.concat(F.lit("+"), s), none)))), "\x01"), none)


def _spread(id_col: Column, text: Column, seed: int) -> Column:
    return F.shiftright(doc_hash(id_col, text, seed=seed), 4).bitwiseAND(F.lit((1 << 60) - 1))


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns kept.

    Rows without words are not taken; nulls, repeated rows and empty tables are
    met as in ``mix``.
    """
    bare = docs.select("*", F.array("source").alias(sources := fresh("sources")))
    rows, _, _ = mix(bare, sources, seed=seed, keep=tuple(docs.columns))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


#: Rounds in which documents small enough fill what the last round left of a pattern.
ROUNDS = 4


#: Rows of a plan that is broadcast at most; a larger one is joined by a shuffle.
SMALL_PLAN = 20_000


def _joined(rows: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """``rows`` with the plan of their pattern; ``n`` is the number of patterns."""
    return rows.join(F.broadcast(plan) if n <= SMALL_PLAN else plan, "pattern")


def _chosen(rows: DataFrame, all_of: DataFrame, base: dict[str, int], want: dict[str, int]) -> DataFrame:
    """The rows of ``all_of`` with their copies: ``base`` times all, and once more so many that sizes come near ``want``.

    Extra documents are taken in the order of their hash until the first that is
    too large; further rounds go on behind that place with documents of at most
    half, and at last of all, of what is still wanted.
    """
    left = {p: w for p, w in want.items() if w > 0}
    most = dict(left)  # the largest size admitted
    behind = {p: -1 for p in left}
    steps: dict[str, list] = {p: [] for p in base}
    for k in range(ROUNDS):
        if not left:
            break
        cuts = _cuts(rows, [(p, behind[p], most[p], w) for p, w in left.items()])
        following = {}
        for p, (cut, ties, filled) in cuts.items():
            steps[p].append((behind[p], most[p], cut, ties))
            if left[p] - filled > 1 and cut < (1 << 60):
                following[p] = left[p] - filled
                behind[p], most[p] = max(cut, behind[p]), max(1, (left[p] - filled) // (2 if k < ROUNDS - 2 else 1))
        left = following
    plan = rows.sparkSession.createDataFrame([(p, n, steps[p]) for p, n in sorted(base.items())] or [("", 0, [])], "pattern string, _base int, _steps array<struct<behind:long,most:long,cut:long,ties:long>>")
    out = _joined(all_of, plan, len(base))
    inside = lambda s: (s["behind"] < F.col("_hash")) & (F.col("size") <= s["most"])
    out = out.withColumn("copies", F.col("_base") + F.exists("_steps", lambda s: inside(s) & (F.col("_hash") < s["cut"])).cast("int"))
    if any(ties for s in steps.values() for *_, ties in s):  # of rows that share the hash at a cut, only some are taken
        at_cut = F.filter("_steps", lambda s: inside(s) & (F.col("_hash") == s["cut"]) & (s["ties"] > 0))
        out = out.withColumn("_ties", F.coalesce(F.get(at_cut, F.lit(0))["ties"], F.lit(0)))
        tied = _tied(out.where("_ties > 0"))
        out = out.where("_ties = 0").unionAll(tied.select(*out.columns))
    out = out.withColumn("copies", F.when(F.col("size") > 0, F.col("copies")).otherwise(0))
    return out.select("doc_id", "size", "pattern", "copies", *[c for c in all_of.columns if c == "row"])


#: Parts in which rows that share a hash are numbered.
TIE_PARTS = 1024


def _tied(rows: DataFrame) -> DataFrame:
    """Rows that share the hash of a cut, with one more copy of the first ``_ties`` of each.

    They may be any number (null ids with one text): numbered in parts by place,
    and the counts of the parts before are added.
    """
    rows = written(rows.withColumn("_place", F.monotonically_increasing_id()), "mix-ties")
    rows = rows.withColumn("_part", F.pmod(doc_hash("_place", seed=SEED), F.lit(TIE_PARTS)))
    part, tie = ["pattern", "_hash", "_part"], Window.partitionBy("pattern", "_hash").orderBy("_part")
    upto = F.sum("n").over(tie.rowsBetween(Window.unboundedPreceding, -1))
    before = rows.groupBy(*part).agg(F.count("*").alias("n")).select(*part, F.coalesce(upto, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*part).orderBy("_place")) + F.col("_before")
    return rows.join(before, part).withColumn("copies", F.col("copies") + (rank <= F.col("_ties")).cast("int"))


def _cuts(rows: DataFrame, wanted: list[tuple[str, int, int, int]]) -> dict[str, tuple[int, int, int]]:
    """For (pattern, behind, most, want): (cut, rows to take at the cut, sizes taken).

    Rows with a hash behind ``behind`` and of a size up to ``most`` are taken
    below the cut. Each step sums sizes by the next 12 bits of the hash inside the
    bucket that holds the cut and finds the next bucket on the executors; one row
    a pattern comes back. After all 60 bits a bucket is a single hash.
    """
    spark = rows.sparkSession
    at = {p: (0, 0) for p, *_ in wanted}  # prefix of the cut, sizes below
    rule = {p: (b, m, w) for p, b, m, w in wanted}
    done: dict[str, tuple[int, int, int]] = {}
    for level in range(5):
        if not at:
            break
        shift = 60 - _BITS * (level + 1)
        here = spark.createDataFrame([(p, x, below, *rule[p]) for p, (x, below) in at.items()], "pattern string, _prefix long, _below long, _behind long, _most long, _want long")
        inside = _joined(rows, here, len(at)).where(F.shiftright("_hash", shift + _BITS) == F.col("_prefix")).where("size > 0 and size <= _most and _hash > _behind")
        sums = inside.groupBy("pattern", "_below", "_want", F.shiftright("_hash", shift).alias("b")).agg(F.sum("size").alias("n"), F.count("*").alias("k"), F.max("size").alias("each"))
        upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("b")) + F.col("_below")
        over = sums.withColumn("upto", upto).groupBy("pattern").agg(F.min(F.when(F.col("upto") > F.col("_want"), F.struct("b", "upto", "n", "k", "each"))).alias("x"), F.max("upto").alias("all"))
        following = {}
        for r in over.collect():
            p = r["pattern"]
            if r["x"] is None:  # all of them fit
                done[p] = (1 << 60, 0, r["all"])
                continue
            b, below = r["x"]["b"], r["x"]["upto"] - r["x"]["n"]
            if r["x"]["k"] > 1 and shift:
                following[p] = (b, below)
            else:  # one row, or rows of one hash
                ties = (rule[p][2] - below) // r["x"]["each"] if r["x"]["k"] > 1 else 0
                done[p] = (b << shift, ties, below + ties * r["x"]["each"])
        for p in at:
            if p not in done and p not in following:
                done[p] = (1 << 60, 0, at[p][1])
        at = following
    return done


def source_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Mix of a table with one ``source`` column: doc_id, size, source, source_size, target, taken, copies.

    Nulls, repeated rows and empty tables are met as in ``mix``.
    """
    spark = docs.sparkSession
    rows, sizes, targets = mix(docs.select("doc_id", "text", F.array("source").alias("sources")), seed=seed)
    stats = spark.createDataFrame([(("\x00" if s is None else "+" + s), s, sizes[s], targets[s]) for s in sizes] or [("", None, 0, 0.0)], "pattern string, source string, source_size long, target double")
    return _joined(rows, stats, len(sizes)).select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op4_source_mixing(spark, sf_dir):
    """All documents under the weights 5, 2, 1; null texts have size 0 and null sources come last, as in ``source_mix``."""
    return source_mix(read(spark, sf_dir, "documents"))
