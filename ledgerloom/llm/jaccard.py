"""Exact Jaccard self-join on word shingles by universe partition and pigeonhole.

Sets fall into size bands ``[l, 2l)``. In a band the universe of shingles is cut,
by hash, into m segments. Two sets of sizes a and b with Jaccard of 0.8 or more
differ in at most (a + b) / 9 shingles, fewer than m: some segments hold
identical subsets. Each set indexes the subset of each of its segments, in its
own band and, where a partner may be there, in the band below. Bands of small
sets use few segments and index one-deletion neighbourhoods as well: then some
segment differs in one shingle at most. Sets that are spread so unevenly that an
empty segment might be all they share also index their single shingles.

Allocation is by cost: the frequency of each subset key is counted first (the
most frequent ones by a sketch and a broadcast, so that no task meets all rows
of a hot key). A set of which too few keys occur elsewhere cannot have a partner
and is dropped; of the others, only as many of the rarest keys as the pigeonhole
needs make candidates. Candidates of one key are compared with its best
connected member (a star, never all pairs), exactly, on the texts. Where a star
leaves a candidate apart from its key's hub, the blocks of nodes in which that
candidate and the members of its key lie are compared, again exactly, so that no
link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Sieve, byte_batches, drop, fresh, joined_words, mix, read, rolled, without, written, written_alone
from .components import components

SHINGLE = 5
#: Similarity of 0.8 as a fraction.
NUM, DEN = 4, 5
#: Bands below this size index one-deletion neighbourhoods.
SMALL = 16
#: Sets in a block of the comparisons, about; rows of the broadcast table of hot keys.
BLOCK, HEAVY = 256, 1024
_U = np.uint64


def shingle_sets(texts: list[bytes | None], k: int = SHINGLE, seed: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, A-Z lower-cased.

    A text with fewer than ``k`` words has its whole sequence as one shingle; one
    without words has none.
    """
    _, _, _, words, first = joined_words([t.lower() if t else t for t in texts], seed=seed)
    grams = rolled(words, k)
    out = []
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64) * _U(0x9E3779B97F4A7C15)
            for w in words[a:b]:
                h = mix(h * _U(0xC2B2AE3D27D4EB4F) + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(s: np.ndarray) -> tuple[int, int]:
    """Identity of a set in 126 bits, as two signed numbers; the first is a multiple of 4."""
    out = []
    with np.errstate(over="ignore"):
        for a, b in ((0x5851F42D4C957F2D, 0x9E3779B97F4A7C15), (0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93)):
            x = mix(s ^ _U(a))
            out.append(int(mix(np.array([x.sum(dtype=np.uint64) * _U(b) + _U(len(s))]))[0].astype(np.int64)))
    return out[0] & ~3, out[1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity is 0.8 or more; empty sets are like nothing."""
    if not len(a) or not len(b) or min(len(a), len(b)) * DEN < NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DEN >= NUM * (len(a) + len(b) - both)


def band_keys(s: np.ndarray, low: int) -> list[tuple[np.ndarray, int]]:
    """Keys of a set in the band [low, 2 * low), with how many of them it must share with a partner.

    One group of keys, or two: partners share enough keys of one of them.
    """
    n, top = len(s), 2 * low - 1
    # A set of the band meets larger ones of the band above here; a set from there meets this band's alone.
    differ = (n + (n * DEN // NUM if n <= top else top)) // 9
    tag = _U(low * 0x9E3779B97F4A7C15 % 2**64)
    h = mix(s + tag)
    value = mix(h ^ _U(0xD1B54A32D192ED03))
    m = (top // 4 + 2) // 2 if low < SMALL else 3 * top // 8 + 1
    base = np.arange(m, dtype=np.uint64) * _U(0xA24BAED4963EE407) + tag
    seg = (h % _U(m)).astype(np.int64)
    total = np.zeros(m, np.uint64)
    np.add.at(total, seg, value)
    held = np.bincount(seg, minlength=m)
    if low < SMALL:
        less = held[seg] > 1
        keys = np.unique(mix(np.concatenate(((total + base)[held > 0], (total[seg] - value + base[seg])[less]))))
        need, uneven = 1, bool((held < 2).any())
    else:
        keys = mix((total + base)[held > 0])
        need = m - differ - int((held == 0).sum())
        uneven = need <= 0
    out = [(keys, max(need, 1))]
    if uneven:  # partners that are uneven too may share nothing but empty segments
        out.append((mix(h + _U(0x8CB92BA72F3D8DD7)), n - differ))
    return out


def bands(n: int) -> list[int]:
    """Lower ends of the bands in which a set of n shingles indexes its keys."""
    if n < NUM:
        return []
    low = 1 << (n.bit_length() - 1)
    out = [low]
    if low > NUM and n * NUM <= (low - 1) * DEN:
        out.append(low // 2)
    return out


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles, two numbers that name the set, and its groups of keys.

    ``node`` is a multiple of 4, and ``ref`` adds the number of the group to it. Of
    copies met in one task, the first alone carries keys.
    """

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids, valid = batch.column(0), batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for first, texts in byte_batches(batch):
                sets = shingle_sets(texts)
                # Sets too small for keys are named by two hashes of their shingles.
                small = [i for i, s in enumerate(sets) if 0 < len(s) < NUM]
                again = {i: set_ids(s)[1] for i, s in zip(small, shingle_sets([texts[i] for i in small], seed=15))}
                names: list = []
                ref, needs, keys, ends = [], [], [], [0]
                for i, s in enumerate(sets):
                    name = set_ids(s) if len(s) else (None, None)
                    names.append((name[0], again[i]) if i in again else name)
                    if len(s) >= NUM and name not in seen and valid[first + i]:
                        if len(seen) < 200_000:
                            seen.add(name)
                        for k, need in [g for low in bands(len(s)) for g in band_keys(s, low)]:
                            ref.append(name[0] + len(keys) - ends[-1])
                            needs.append(need)
                            keys.append(k)
                    ends.append(len(keys))
                sizes = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
                flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
                groups = pa.StructArray.from_arrays([pa.array(ref, pa.int64()), pa.array(needs, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))], ["ref", "need", "keys"])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in names], pa.int64()), pa.array([y for _, y in names], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), groups)],
                    ["doc_id", "mark", "n_shingles", "node", "twin", "groups"],
                )

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, n_shingles long, node long, twin long, groups array<struct<ref:long,need:int,keys:array<long>>>")


def _shared_keys(sets: DataFrame) -> DataFrame:
    """(ref, key, often): keys that more than one set has, with their frequency.

    ``ref`` names a set and its group of keys. A sketch names the keys that may be
    hot; they are counted exactly, and a table of at most HEAVY rows settles them
    on the map side. Other keys are shuffled once.
    """
    keys = sets.select(F.expr("inline(transform(groups, g -> struct(g.ref AS ref, g.keys AS keys)))")).select("ref", F.explode("keys").alias("key"))
    n = sets.agg(F.sum(F.expr("aggregate(groups, 0L, (n, g) -> n + size(g.keys))"))).first()[0] or 0
    likely = keys.selectExpr(f"explode(approx_top_k(key, {HEAVY}, {8 * HEAVY})) AS top").where(F.col("top.count") * (8 * HEAVY) >= n).select(F.col("top.item").alias("key"))
    likely = written(likely, "likely-keys")
    count = [F.count("*").alias("often"), F.min("ref").alias("least"), F.max("ref").alias("most")]
    heavy = written(keys.join(F.broadcast(likely), "key", "left_semi").groupBy("key").agg(*count), "heavy-keys")
    settled = keys.join(F.broadcast(heavy.where("least < most").select("key", "often")), "key")
    alike = Window.partitionBy("key")
    rest = keys.join(F.broadcast(heavy.select("key")), "key", "left_anti").select("*", *[c.over(alike).alias(name) for c, name in ((F.count("*"), "often"), (F.min("ref"), "least"), (F.max("ref"), "most"))]).where("least < most")
    return settled.select("ref", "key", "often").unionAll(rest.select("ref", "key", "often"))


def _prefixes(shared: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, hub): the rarest shared keys of each set that may have a partner."""
    groups = sets.select("node", F.expr("inline(transform(groups, g -> struct(g.ref AS ref, g.need AS need, size(g.keys) AS total)))")).groupBy("ref").agg(F.first("node").alias("node"), F.min("need").alias("need"), F.max("total").alias("total"))
    own = Window.partitionBy("ref")
    x = shared.withColumn("rank", F.dense_rank().over(own.orderBy("often", "key")))  # a copy's keys rank alike
    x = x.select("*", F.max("rank").over(own).alias("have"), F.sum(F.log2("often")).over(own).alias("weight")).join(groups, "ref")
    x = x.where((F.col("have") >= F.col("need")) & (F.col("rank") <= F.col("have") - F.col("need") + 1))
    return x.select("key", "node", (1000 * F.col("weight") / F.col("total")).cast("long").alias("hub"))


def _blocks(pairs: DataFrame) -> DataFrame:
    """(node, block): nodes in blocks of about BLOCK, near ones together: those with the same least node within two steps."""
    both = pairs.select(F.col("a").alias("node"), "b").unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("b")))
    one = written(both.groupBy("node").agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m")), "nearest")
    two = both.join(one.select(F.col("node").alias("b"), "m"), "b").groupBy("node").agg(F.min("m").alias("m"))
    family = written(two.join(one.withColumnRenamed("m", "own"), "node").select("node", F.least("m", "own").alias("family")), "families")
    sizes = family.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    block = F.xxhash64("family", F.pmod(F.xxhash64("node", F.lit(4)), F.col("nb")))
    return written(family.join(sizes, "family").select("node", block.alias("block")), "blocks")


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    sets: list[np.ndarray] = []
    for batch in table.select(["text"]).to_batches():
        for _, texts in byte_batches(batch):
            sets += shingle_sets(texts)
    return sets


def _verified(pairs: DataFrame, blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar. A task gets the pairs between two blocks, and each text in them once."""
    x, y = blocks.select(F.col("node").alias("a"), F.col("block").alias("x")), blocks.select(F.col("node").alias("b"), F.col("block").alias("y"))
    placed = pairs.join(x, "a").join(y, "b").select("a", "b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    placed = written(placed, "placed-pairs")
    own = placed.select(F.col("x").alias("u"), F.col("y").alias("v"), F.explode(F.array("a", "b")).alias("node")).distinct().join(texts, "node")

    def run(left, right):
        sets: dict[int, list[np.ndarray]] = {}
        for node, s in zip(left.column("node").to_pylist(), _sets_of(left)):
            sets.setdefault(node, []).append(s)  # rows that repeat an id may have several texts
        a, b = right.column("a").to_pylist(), right.column("b").to_pylist()
        keep = [any(similar(s, t) for s in sets.get(i, ()) for t in sets.get(j, ())) for i, j in zip(a, b)]
        return right.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return own.groupBy("u", "v").cogroup(placed.groupBy("x", "y")).applyInArrow(run, "a long, b long")


def _leftovers(members: DataFrame, blocks: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between strays and nodes under another label that share a key with them.

    ``members``: key, node, label, stray. Where a key joins strays of one block
    with members of another, a task compares those strays with those members. For
    each stray and other label one link is returned, which is all that components need.
    """
    placed = members.join(blocks, "node")
    of = placed.select("key", F.col("block").alias("mb")).distinct()
    meet = placed.where("stray").select("key", F.col("block").alias("sb")).distinct().join(of, "key").select("sb", "mb").distinct()
    meet = written(meet, "block-pairs")
    nodes = written(placed.groupBy("node").agg(F.first("block").alias("block"), F.first("label").alias("label"), F.max("stray").alias("stray")).join(texts, "node"), "block-members")
    query = nodes.where("stray").join(meet, nodes["block"] == meet["sb"]).select("sb", "mb", "node", "label", "text", F.lit(True).alias("query"))
    own = nodes.join(meet, nodes["block"] == meet["mb"]).select("sb", "mb", "node", "label", "text", F.lit(False).alias("query"))

    def run(table):
        node, label, query = table.column("node").to_numpy(), table.column("label").to_numpy(), table.column("query").to_numpy(zero_copy_only=False)
        sets, own = _sets_of(table), np.flatnonzero(~query)
        out_a, out_b = [], []
        if len(own):
            size = np.array([len(sets[i]) for i in own])
            token, who = np.concatenate([sets[i] for i in own]), np.repeat(np.arange(len(own)), size)
            order = np.argsort(token, kind="stable")
            token, who = token[order], who[order]
            for i in np.flatnonzero(query):
                s = sets[i]
                a, b = np.searchsorted(token, s, "left"), np.searchsorted(token, s, "right")
                n = b - a
                at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(who[at], minlength=len(own))
                good = (both * DEN >= NUM * (size + len(s) - both)) & (both > 0) & (label[own] != label[i])
                _, pick = np.unique(label[own][good], return_index=True)
                for j in own[good][pick]:
                    out_a.append(int(node[i]))
                    out_b.append(int(node[j]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return query.unionAll(own).groupBy("sb", "mb").applyInArrow(run, "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, mark (hash of the text), n_shingles, component_id.

    Two rows link when their sets of 5-word shingles have a Jaccard similarity of
    0.8 or more; a component is named by its smallest doc_id. Null and empty texts
    and texts without words have no shingles and are components of their own, as
    are rows with a null id. Repeated rows share a component. Equal sets are one
    node from the start, so copies cost nothing more; sets are told apart by 128
    bits. Rows that repeat an id with other texts are grouped each by its text,
    but may bring their groups together. Very long texts are read whole. Other
    columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # The result is written, so that the tables on the way can go.
    return written_alone(lambda: _groups(docs), "jaccard-groups")


def _groups(docs: DataFrame) -> DataFrame:
    sets = written(_sets(docs.withColumn("mark", F.xxhash64("text"))), "sets")
    named = sets.where("node is not null and doc_id is not null")
    # The least id of equal sets stands for them.
    classes = written(named.groupBy("node", "twin").agg(F.min("doc_id").alias("doc_id")), "set-classes")
    keyed = written(_prefixes(_shared_keys(named), named), "prefix-keys")
    top = keyed.groupBy("key").agg(F.max(F.struct("hub", "node")).alias("top"), F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key", F.col("top.node").alias("b"))
    members = written(keyed.join(written(top, "key-hubs"), "key").select("key", "node", "b"), "key-members")
    drop(keyed)
    nodes = members.select("node").distinct()
    wanted = written(nodes.join(classes, "node"), "candidate-docs")
    at, hub = wanted.select("node", F.col("doc_id").alias("a")), wanted.select(F.col("node").alias("b"), F.col("doc_id").alias("to"))
    pairs = members.where("node <> b").select("node", "b").distinct().join(at, "node").join(hub, "b").select("a", F.col("to").alias("b"))
    pairs = written(pairs, "candidates")
    texts = Sieve(wanted, "doc_id").prune(docs.where("doc_id is not null"), "doc_id").join(wanted, "doc_id")
    # Rows that repeat an id with another text are told apart by the set's identity.
    # Written once more so that joins meet bare exchanges, which adaptive execution can split at hot hubs.
    texts = written(written(_of_set(texts), "candidate-rows").dropDuplicates(["node", "twin"]).select(F.col("doc_id").alias("node"), "text"), "candidate-texts")
    blocks = _blocks(pairs)
    links = written(_verified(pairs, blocks, texts), "links-star")
    labels = written(components(links), "labels")
    la, lb = labels.select(F.col("node").alias("a"), F.col("component").alias("la")), labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
    apart = pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    apart = written(apart, "apart")
    groups = labels
    if apart.take(1):
        byname = members.join(at, "node").join(hub, "b").select("key", F.col("a").alias("node"), F.col("to").alias("b"))
        byname = byname.join(apart.select(F.col("a").alias("node"), "b", F.lit(True).alias("stray")).distinct(), ["node", "b"], "left")
        byname = byname.groupBy("key", "node").agg(F.coalesce(F.max("stray"), F.lit(False)).alias("stray"))
        byname = written(byname, "named-members")
        keys = byname.where("stray").select("key").distinct()
        byname = byname.join(keys, "key").join(labels.withColumnRenamed("component", "label"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "stray")
        more = written(_leftovers(written(byname, "stray-keys"), blocks, texts), "links-blocks")
        if more.take(1):
            groups = written(components(links.unionAll(more)), "set-groups")
    # Nodes are named by ids, so the least node of a component is its least id.
    name = written(classes.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("node", "twin", F.coalesce("component", "doc_id").alias("component_id")), "set-names")
    return sets.join(name, ["node", "twin"], "left").select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))


def _of_set(texts: DataFrame) -> DataFrame:
    """Rows (doc_id, node, twin, text) whose text has the set that ``node`` and ``twin`` name."""

    def run(batches):
        for batch in batches:
            names = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
            keep = np.zeros(len(batch), bool)
            for first, some in byte_batches(batch):
                for i, s in enumerate(shingle_sets(some), first):
                    keep[i] = len(s) > 0 and set_ids(s) == names[i]
            yield batch.filter(pa.array(keep))

    return texts.select("doc_id", "node", "twin", "text").mapInArrow(run, "doc_id long, node long, twin long, text string")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns.

    Rows without shingles stay, and so do rows with a null id.
    """
    one, two = fresh("id"), fresh("mark")
    out = jaccard_groups(docs, id_col, text_col).where("component_id <> doc_id").select("doc_id", "mark").distinct()
    return without(docs, written(out.toDF(one, two), "near-copies"), id_col, F.xxhash64(text_col), one, two)


def op5_ngram_jaccard_join(spark, sf_dir):
    """All documents; those without words link with nothing, null ids and repeated rows as in ``jaccard_groups``."""
    return jaccard_groups(read(spark, sf_dir, "documents")).drop("mark")
