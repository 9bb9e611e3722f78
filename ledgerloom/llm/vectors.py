"""Near-duplicate vectors by search in a flat, robustly pruned graph.

Equal vectors are one node. Nodes are dealt to overlapping shards: vectors of each
length are split by k-means, and shards over the cap are split again, so centroids
grow with the table. In each shard a flat graph is built: every node keeps
neighbours that no chosen neighbour shadows (robust pruning), so edges are short
and long ones alike. The lists that a node got in its shards are united. Each node
is then searched for once, in its home shard with all nodes outside that the
united lists of the shard's members reach within range: greedily from the medoid,
then outward through every node within range. Links are verified in double
precision.

A group of vectors too dense to be split stays one shard, whose members within
half the link angle of its centre are all linked with one another, which needs no
comparison; the others are dealt to parts, and each is searched for in every part.
Recall is audited against brute force on a sample of queries; where it falls
short, the overlap grows and the work is redone. Where the audit falls short at
the greatest overlap too, all nodes are compared with all others in blocks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_hash, drop, read, written
from .components import components

THRESHOLD = 0.95
#: Nodes in a part at most, about, and out-edges of a node in a part.
CAP, DEGREE = 1500, 24
#: Vectors that place the centroids of a shard, its centroids at most, and rows dealt to them in one task.
SAMPLE, SPLIT, CHUNK = 8192, 256, 20_000
#: Rounds of splitting; a shard still over the cap then is dealt to parts like a dense one.
LEVELS = 6
#: Queries of the audit with links and without.
AUDIT, UNLINKED = 256, 2048
#: Least recall of the audit, and shards of a node at first and at most.
RECALL, OVERLAP, MOST = 0.97, 2, 5
ALPHA, BEAM, SLACK = 1.2, 24, 0.08
#: Queries compared with all nodes at once, where the graph falls short.
QUERIES = 4096
SEED = 6


def _matrix(column) -> np.ndarray:
    """Rows of an array<double> column without nulls, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _by_length(column: pa.Array):
    """(rows, matrix) of the vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, _matrix(column.take(pa.array(rows)))


def unit_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, unit (array<double>; null where the vector cannot link) and a 128-bit digest of it."""

    def run(batches):
        for batch in batches:
            units, marks = [], []
            for v in batch.column(1):
                v = v.as_py()
                x = None if v is None or not v or any(e is None for e in v) else np.asarray(v, np.float64)
                big = float(np.abs(x).max()) if x is not None and np.isfinite(x).all() else 0.0
                if big > 0:
                    x = x / big
                    x = x / np.sqrt((x * x).sum()) + 0.0  # no negative zeros
                    units.append(x)
                    marks.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                else:
                    units.append(None)
                    marks.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(pa.float64())), pa.array(marks, pa.binary())], ["vec_id", "unit", "mark"])

    return table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, unit array<double>, mark binary")


def _centroids(v: np.ndarray, k: int, tight: float = THRESHOLD - SLACK) -> np.ndarray:
    """Spherical k-means with a fixed start; clusters whose members link across are one."""
    rng = np.random.default_rng(SEED)
    c = v[np.sort(rng.choice(len(v), min(k, len(v)), replace=False))]
    for _ in range(8):
        who = (v @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, who, v)
        norm = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(norm > 0, s / np.where(norm > 0, norm, 1), c)
    return _merged(v, c, tight)


def _merged(v: np.ndarray, c: np.ndarray, tight: float) -> np.ndarray:
    """Centroids after joining, closest first, clusters of ``v`` with a mean cosine of ``tight`` or more between them.

    The mean over pairs of members tells a dense group that was cut up from wide
    clusters whose centroids are close because they are means of many rows.
    """
    who = (v @ c.T).argmax(1)
    s = np.zeros_like(c)
    np.add.at(s, who, v)
    size = np.bincount(who, minlength=len(c)).astype(np.float64)
    between = (s @ s.T) / np.maximum(np.outer(size, size), 1)
    between[size == 0] = between[:, size == 0] = -1
    np.fill_diagonal(between, -1)
    joined, gone = np.zeros(len(c), bool), np.zeros(len(c), bool)
    while True:
        a, b = divmod(int(between.argmax()), len(c))
        if between[a, b] < tight:
            break
        s[a] += s[b]
        size[a] += size[b]
        joined[a], gone[b] = True, True
        between[b] = between[:, b] = -1
        live = between[a] > -1
        between[a, live] = between[live, a] = (s[live] @ s[a]) / (size[live] * size[a])
    c = np.where(joined[:, None], s / np.maximum(np.linalg.norm(s, axis=1, keepdims=True), 1e-300), c)
    return c[~gone]


def robust_prune(v: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 96) -> list[np.ndarray]:
    """Out-neighbours of each row of ``v`` (unit vectors), with a spine to the medoid."""
    n = len(v)
    out: list[np.ndarray] = []
    middle = medoid(v)
    for a in range(0, n, 512):
        sims = v[a : a + 512] @ v.T
        take = min(pool, n - 1)
        near = np.argpartition(-sims, min(take, n - 1), axis=1)[:, : take + 1] if n > 1 else np.zeros((len(sims), 0), int)
        for i in range(len(sims)):
            c = near[i][near[i] != a + i]
            c = c[np.argsort(-sims[i][c], kind="stable")]
            d = 1 - sims[i][c]
            between = 1 - v[c] @ v[c].T
            alive, chosen = np.ones(len(c), bool), []
            for j in range(len(c)):
                if alive[j]:
                    chosen.append(int(c[j]))
                    if len(chosen) >= degree:
                        break
                    alive &= alpha * between[j] > d
            if len(chosen) < degree:  # near ones that were shadowed fill what room is left
                chosen += [int(x) for x in c if x not in chosen][: degree - len(chosen)]
            out.append(np.array(chosen, np.int64))
    spine = np.random.default_rng(SEED).permutation(n)[: max(1, 2 * degree)]
    out[middle] = np.unique(np.concatenate((out[middle], spine[spine != middle]))) if n > 1 else out[middle]
    return out


def medoid(v: np.ndarray) -> int:
    return int((v @ v.mean(0)).argmax())


def range_search(v: np.ndarray, graph: np.ndarray, q: np.ndarray, start: int, threshold: float = THRESHOLD, beam: int = BEAM, slack: float = SLACK) -> np.ndarray:
    """Which rows of ``v`` are within range of each row of ``q``, as far as the graph leads.

    ``graph`` has a row of out-neighbours for each row of ``v``, filled up with -1.
    For each query, a best-first walk with ``beam`` places goes from ``start``
    towards it; then all nodes within range, and a little beyond, are expanded
    until none is new. Queries take their steps together.
    """
    n, m = len(v), len(q)
    seen, done = np.zeros((m, n), bool), np.zeros((m, n), bool)
    sims = np.full((m, n), -3.0)
    seen[:, start] = True
    sims[:, start] = q @ v[start]
    active = np.arange(m)
    while len(active):
        some = sims[active]
        left = np.where(done[active], -3.0, some)
        best = left.argmax(1)
        top = left[np.arange(len(active)), best]
        go = (top > -2) & ((some > top[:, None]).sum(1) < beam)
        active, best = active[go], best[go]
        done[active, best] = True
        near = graph[best]
        row, at = np.nonzero((near >= 0) & ~seen[active[:, None], near])
        row, node = active[row], near[row, at]
        seen[row, node] = True
        sims[row, node] = np.einsum("ij,ij->i", q[row], v[node])
    while True:
        row, node = np.nonzero((sims >= threshold - slack) & ~done)
        if not len(row):
            return sims >= threshold
        done[row, node] = True
        fresh = np.zeros((m, n + 1), bool)
        fresh[row[:, None], graph[node]] = True  # -1 falls in the last column
        row, node = np.nonzero(fresh[:, :n] & ~seen)
        seen[row, node] = True
        sims[row, node] = np.einsum("ij,ij->i", q[row], v[node])


def _split(placed: DataFrame, overlap: int, core: float) -> DataFrame:
    """One more round of k-means in every open shard over the cap.

    Rows are shard, home, open, core, node, first, unit and copies. A node's home
    row goes to ``overlap`` children, its other rows to one. A child is closed
    when its shard could not be split.
    """
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"), F.max("open").alias("o"))
    sizes = written(sizes.where("o").select("shard", "n", (F.col("n") > CAP).alias("big")), "shard-sizes")
    rows = placed.join(sizes, "shard", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    big = rows.where("big")
    u = F.pmod(doc_hash("first", "shard", seed=SEED + 1), F.lit(1 << 30)) / float(1 << 30)

    def fit(table):
        v = _matrix(table.column("unit"))[np.argsort(table.column("first").to_numpy(), kind="stable")]
        n = table.column("n")[0].as_py()
        c = _centroids(v, min(SPLIT, max(2, -(-2 * n // CAP))))
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()] * len(c), pa.int64()), "child": pa.array(range(len(c)), pa.int64()), "centre": pa.array(list(c), pa.list_(pa.float64())), "chunks": pa.array([-(-n // CHUNK)] * len(c), pa.int32())})

    # About SAMPLE vectors of a shard come to one task, SPLIT centroids leave it.
    centres = written(big.where(u < F.lit(SAMPLE) / F.col("n")).select("shard", "n", "first", "unit").groupBy("shard").applyInArrow(fit, "shard long, child long, centre array<double>, chunks int"), "centroids")
    each = centres.select("shard", "child", "centre", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    kinds = {"shard": pa.int64(), "home": pa.bool_(), "open": pa.bool_(), "core": pa.bool_(), "node": pa.int64(), "first": pa.int64(), "unit": pa.list_(pa.float64()), "copies": pa.int64()}
    parts = big.withColumn("chunk", F.pmod(doc_hash("first", seed=SEED + 4), F.ceil(F.col("n") / CHUNK)).cast("int"))

    def deal(left, right):
        if not len(left):
            return pa.table({f: pa.array([], t) for f, t in kinds.items()})
        v, home = _matrix(left.column("unit")), left.column("home").to_numpy(zero_copy_only=False)
        order = np.argsort(right.column("child").to_numpy())
        c = _matrix(right.column("centre").take(pa.array(order))) if len(right) else v[:1]
        sims = v @ c.T
        near = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
        which = np.ones(near.shape, bool)
        which[~home, 1:] = False
        row, rank = np.nonzero(which)
        child = near[row, rank]
        out = left.select(["node", "first", "unit", "copies"]).take(pa.array(row))
        # Each shard has its own range of children: the path of choices in base SPLIT.
        shard = left.column("shard").to_numpy()[row] * SPLIT + child
        return pa.table([pa.array(shard), pa.array(home[row] & (rank == 0)), pa.array(np.full(len(row), len(c) > 1)), pa.array(sims[row, child] >= core), *out.columns], names=["shard", "home", "open", "core", *out.column_names])

    dealt = parts.groupBy("shard", "chunk").cogroup(each.groupBy("shard", "chunk")).applyInArrow(deal, placed.schema)
    rest = rows.where("not big").select("shard", "home", F.lit(False).alias("open"), "core", "node", "first", "unit", "copies")
    # Ranges of children stay apart from shards that are done, which are numbered below zero.
    done = rest.withColumn("shard", F.when(F.col("shard") >= 0, -1 - F.xxhash64("shard").bitwiseAND(F.lit((1 << 62) - 1))).otherwise(F.col("shard")))
    return written(dealt.unionAll(done), "placed")


def _build(members: DataFrame, threshold: float) -> DataFrame:
    """(node, near, close): out-neighbours in each part, and those of them in range or a little beyond."""

    def run(table):
        node, v = table.column("node").to_numpy(), _matrix(table.column("unit"))
        order = np.argsort(table.column("first").to_numpy(), kind="stable")
        node, v = node[order], v[order]
        graph = robust_prune(v)
        close = [g[v[g] @ v[i] >= threshold - SLACK] for i, g in enumerate(graph)]
        return pa.table({"node": node, "near": pa.array([node[g] for g in graph], pa.list_(pa.int64())), "close": pa.array([node[g] for g in close], pa.list_(pa.int64()))})

    return members.select("shard", "part", "node", "first", "unit").groupBy("shard", "part").applyInArrow(run, "node long, near array<long>, close array<long>")


def _search(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, links, group): links found in a part, and the least node of its group there."""

    def run(table):
        kind = np.array(table.column("kind").to_pylist())
        order = np.lexsort((table.column("first").to_numpy(), kind))
        table = table.take(pa.array(order))
        kind = kind[order]
        node, v, copies = table.column("node").to_numpy(), _matrix(table.column("unit")), table.column("copies").to_numpy()
        home, core, parted = (table.column(c).to_numpy(zero_copy_only=False) for c in ("home", "core", "parted"))
        # Kinds: 0 members, 1 nodes that their lists reach, 2 members of other parts of a dense shard.
        inside = np.flatnonzero(kind < 2)
        own = int((kind == 0).sum())
        if not own:
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "group": pa.array([], pa.int64())})
        w, names = v[inside], node[inside]
        place = {int(x): j for j, x in reversed(list(enumerate(names)))}
        near = [[j for x in (g or ()) if (j := place.get(x)) is not None] for g in table.column("near").take(pa.array(inside)).to_pylist()]
        graph = np.full((len(w), max(1, max(map(len, near)))), -1, np.int64)
        for j, g in enumerate(near):
            graph[j, : len(g)] = g
        start = medoid(w[:own])
        # In a dense shard, core members link with one another; only the others ask, and answer for both.
        # Nodes from outside are loaded in several parts, so only a part's own members may count them.
        dense = parted & core
        outside = kind[inside] == 1
        ask = np.flatnonzero(np.where(parted, ~core & (kind != 1), home & (kind == 0)))
        links, label = np.zeros(len(v), np.int64), np.arange(len(v))
        some_a, some_b = [], []
        for a in range(0, len(ask), 256):
            q = ask[a : a + 256]
            good = range_search(w, graph, v[q], start, threshold)
            good &= (node[q][:, None] != names[None, :]) & ~(outside[None, :] & (kind[q] == 2)[:, None])
            links[q] += np.where(home[q], good @ copies[inside], 0)
            r, c = np.nonzero(good)
            some_a.append(q[r])
            some_b.append(inside[c])
            back = dense[inside[c]] & home[inside[c]]
            np.add.at(links, inside[c][back], copies[q[r][back]])
        q = np.flatnonzero(dense & home & (kind == 0))
        if len(q) and outside.any():
            r, c = np.nonzero(v[q] @ w[outside].T >= threshold)
            c = np.flatnonzero(outside)[c]
            np.add.at(links, q[r], copies[inside[c]])
            some_a.append(q[r])
            some_b.append(inside[c])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (some_a, some_b))
        while True:
            least = label.copy()
            np.minimum.at(least, a, label[b])
            np.minimum.at(least, b, label[a])
            least = least[least]
            if (least == label).all():
                break
            label = least
        told = np.flatnonzero((links > 0) | (label != np.arange(len(v))))
        return pa.table({"node": node[told], "links": links[told], "group": node[label[told]]})

    return rows.groupBy("shard", "part").applyInArrow(run, "node long, links long, group long")


def _graph_links(nodes: DataFrame, overlap: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, component) found with one overlap."""
    core = math.cos(math.acos(threshold) / 2) + 1e-9
    placed = nodes.select(F.size("unit").cast("long").alias("shard"), F.lit(True).alias("home"), F.lit(True).alias("open"), F.lit(False).alias("core"), "node", "first", "unit", "copies")
    placed = written(placed, "placed")
    for _ in range(LEVELS):
        if not placed.where("open").groupBy("shard").count().where(F.col("count") > CAP).take(1):
            break
        following = _split(placed, overlap, core)
        drop(placed)
        placed = following
    sizes = placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("core_copies"), F.min(F.when(F.col("core"), F.col("node"))).alias("core_node"))
    sizes = written(sizes.select("shard", F.ceil(F.col("n") / CAP).cast("int").alias("parts"), "core_copies", "core_node"), "part-sizes")
    each = placed.join(sizes, "shard").withColumn("part", F.pmod(doc_hash("first", seed=SEED + 2), F.col("parts")).cast("int")).withColumn("parted", F.col("parts") > 1)
    each = written(each, "members")
    lists = written(_build(each, threshold).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.array_distinct(F.flatten(F.collect_list("close"))).alias("close")), "adjacency")
    columns = ["shard", "part", "node", "first", "unit", "copies", "home", "core", "parted", "near", "kind"]
    own = each.join(lists, "node").withColumn("kind", F.lit(0))
    asking = each.where("home or parted").join(lists.select("node", "close"), "node").select("shard", "part", "parted", F.explode("close").alias("node")).distinct()
    reached = asking.join(each.select("shard", "node"), ["shard", "node"], "left_anti")
    reached = reached.join(nodes.select("node", "first", "unit", "copies"), "node").join(lists.select("node", "near"), "node").withColumns({"home": F.lit(False), "core": F.lit(False), "kind": F.lit(1)})
    away = each.where("parted and not core").select("*", F.lit(None).cast("array<long>").alias("near"), F.lit(2).alias("kind"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to")).where("`to` <> part")
    rows = own.select(columns).unionAll(reached.select(columns)).unionAll(away.withColumn("part", F.col("to")).select(columns))
    links = written(_search(rows, threshold), "vector-links")
    dense = each.where("parted and core").select("node", F.when(F.col("home"), F.col("core_copies") - F.col("copies")).otherwise(0).alias("links"), F.col("core_node").alias("group"))
    links = links.unionAll(dense)
    found = written(links.groupBy("node").agg(F.sum("links").alias("links")), "link-counts")
    groups = written(components(links.where("node <> `group`").select(F.col("node").alias("a"), F.col("group").alias("b"))), "vector-groups")
    for t in (placed, each, lists):
        drop(t)
    return found, groups


def _audit(nodes: DataFrame, found: DataFrame, threshold: float, most: int = AUDIT, unlinked: int = UNLINKED) -> float:
    """Recall by link or by query, whichever is worse, of sampled queries that are compared with all nodes in blocks.

    By query, each one's share counts alike, so that pairs weigh as much as the
    members of large groups. Nodes with links and nodes without are sampled apart
    and weighed by the nodes they stand for: a pair that was lost is among the latter.
    """
    n = nodes.count()
    u = F.pmod(doc_hash("first", seed=SEED), F.lit(1 << 30)) / float(1 << 30)
    linked = found.where("links > 0").select("node", "links")
    m = linked.count()
    shares = min(1.0, most / max(m, 1)), min(1.0, unlinked / max(n - m, 1))
    some = nodes.join(linked, "node", "left").where(u < F.when(F.col("links").isNotNull(), shares[0]).otherwise(shares[1])).select("node", "unit", F.coalesce("links", F.lit(0)).alias("links")).toArrow()
    if not some.num_rows:
        return 1.0
    ids = some.column("node").to_numpy()
    held = nodes.sparkSession.sparkContext.broadcast({v.shape[1]: (ids[at], v) for at, v in _by_length(some.column("unit").combine_chunks())})

    def run(batches):
        for batch in batches:
            for rows, v in _by_length(batch.column(1)):
                some, q = held.value.get(v.shape[1], (np.zeros(0, np.int64), np.zeros((0, v.shape[1]))))
                c, own = batch.column(2).to_numpy()[rows], batch.column(0).to_numpy()[rows]
                true = ((q @ v.T >= threshold) & (some[:, None] != own[None, :])) @ c
                yield pa.RecordBatch.from_arrays([pa.array(some[true > 0]), pa.array(true[true > 0])], ["node", "true"])

    counts = nodes.select("node", "unit", "copies").mapInArrow(run, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    true = {r[0]: r[1] for r in counts.collect()}  # at most one row a query
    got = [(true[i], min(true[i], k), 1 / shares[0 if k else 1]) for i, k in zip(ids.tolist(), some.column("links").to_pylist()) if i in true]
    if not got:
        return 1.0
    t, k, w = np.array(got, np.float64).T
    return float(min((w * k).sum() / (w * t).sum(), (w * k / t).sum() / w.sum()))


def link_vectors(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, float]:
    """(one row for each input row: vec_id, n_links, component_id, kept; audited recall, at least RECALL).

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing and are components of their own; others are compared with those
    of their own length. Equal vectors are one node; each copy counts in
    ``n_links``. A row with a null id links with nothing. Other columns are not
    read. An empty table gives an empty result.
    """
    rows = written(unit_vectors(table, id_col, vec_col), "units")
    good = rows.where("mark is not null and vec_id is not null")
    nodes = good.groupBy("mark").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min_by("unit", "vec_id").alias("unit"))
    nodes = written(nodes.select("mark", F.monotonically_increasing_id().alias("node"), "first", "copies", "unit"), "nodes")
    slim = nodes.select("node", "first", "copies", "unit")
    overlap = OVERLAP
    found, groups = _graph_links(slim, overlap, threshold)
    while (recall := _audit(slim, found, threshold)) < RECALL:
        overlap += 1
        if overlap > MOST:
            found, groups = _exact_links(slim, threshold)
            recall = 1.0
            break
        found, groups = _graph_links(slim, overlap, threshold)
    named = nodes.select("mark", "node", "first", "copies").join(found, "node", "left").join(groups, "node", "left")
    named = written(named.select("mark", "first", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named-nodes")
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    marks = written(named.join(names, "component").select("mark", "n_links", "component_id"), "named-marks")
    out = good.select("vec_id", "mark").join(marks, "mark").select("vec_id", "n_links", "component_id")
    rest = rows.where("mark is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall


def _exact_links(nodes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, links) and (node, component) by brute force, about QUERIES nodes against all at once."""
    rounds = max(1, -(-nodes.count() // QUERIES))
    block = F.pmod(doc_hash("first", seed=SEED + 3), F.lit(rounds))
    far = np.iinfo(np.int64).max

    def compared(r: int) -> DataFrame:
        some = nodes.where(block == r).select("node", "unit", "copies").toArrow()
        of, n_of = some.column("node").to_numpy(), some.column("copies").to_numpy()
        held = nodes.sparkSession.sparkContext.broadcast({v.shape[1]: (of[at], v, n_of[at]) for at, v in _by_length(some.column("unit").combine_chunks())} if len(of) else {})

        def run(batches):
            for batch in batches:
                for at, w in _by_length(batch.column(1)):
                    for a in range(0, len(at) if w.shape[1] in held.value else 0, 1024):
                        ids, q, copies = held.value[w.shape[1]]
                        own, v = batch.column(0).to_numpy()[at[a : a + 1024]], w[a : a + 1024]
                        near = (v @ q.T >= threshold) & (own[:, None] != ids[None, :])
                        i, j = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
                        near = near[np.ix_(i, j)]
                        rows, cols = own[i], ids[j]
                        while len(i):  # least node of each group in this block
                            down = np.minimum(rows, np.where(near, cols[None, :], far).min(1))
                            over = np.minimum(cols, np.where(near, down[:, None], far).min(0))
                            same = (down == rows).all() and (over == cols).all()
                            rows, cols = down, over
                            if same:
                                break
                        other = cols != ids[j]
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((own[i], ids[j][other]))), pa.array(np.concatenate((near @ copies[j], np.zeros(other.sum(), np.int64)))), pa.array(np.concatenate((rows, cols[other])))], ["node", "links", "group"])

        return nodes.select("node", "unit").mapInArrow(run, "node long, links long, group long")

    made: list[DataFrame] = []
    for r in range(rounds):
        made.append(written(compared(r), "block-links"))
        if len(made) == 32 or r == rounds - 1:  # plans stay short
            whole = made[0]
            for t in made[1:]:
                whole = whole.unionAll(t)
            whole = written(whole, "exact-links")
            for t in made:
                drop(t)
            made = [whole]
    links = made[0]
    found = written(links.groupBy("node").agg(F.sum("links").alias("links")), "link-counts")
    return found, components(links.where("node <> `group`").select(F.col("node").alias("a"), F.col("group").alias("b")))


def op6_embedding_near_dedup(spark, sf_dir):
    """All vectors; unusable ones link with nothing, null ids and repeated rows as in ``link_vectors``."""
    out, recall = link_vectors(read(spark, sf_dir, "embeddings"))
    return out.withColumn("audited_recall", F.lit(recall))
