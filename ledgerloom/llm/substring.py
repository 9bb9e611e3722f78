"""Substring dedup by compaction of a De Bruijn graph of words.

The edges of the graph are runs of K consecutive words; an edge joins the nodes of
its first and its last K - 1 words. Only what may repeat becomes edges: in every
window of SPAN words the edge with the least hash is its sample, the same one in
equal windows, so windows whose sample is met in one document only are left out,
and stretches of windows that are equal as a whole are walked once, in the
document with the smallest id.

The walks' edges are counted, and those met in several documents make the graph,
each with a source coordinate: the first place where it stands. Degrees of nodes
are counted; paths through nodes with one edge in and one out compact, first
along source coordinates, then by pointer doubling where the source changes, both
with joins. A window is then named by its place on the compacted path and by the
branches that it takes. Windows with one name repeat; neighbouring ones make long
spans with a source span each. Every span is verified: the words at both places
are hashed anew, with other seeds, to 128 bits. Where they differ, all windows
with the same samples are told apart by such hashes instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Sieve, byte_batches, drop, joined_words, mix, read, rolled, written

SPAN = 50
K = 12
_U = np.uint64
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = _U((1 << 30) - 1)
#: Seeds of the hashes that verify spans.
_CHECKS = (101, 202)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Stretch:
    """Hashes of any stretch of a word sequence in constant time."""

    def __init__(self, words: np.ndarray):
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words) * _powers(_BASE, len(words)) if len(words) else words)))
        self.back = _powers(_BACK, len(words) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def _least(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, by block prefixes and suffixes."""
    n = len(v)
    pad = np.concatenate((v, np.full(-n % w, _U(2**64 - 1)))).reshape(-1, w)
    left = np.minimum.accumulate(pad, 1).ravel()
    right = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _words(texts: list[bytes | None], bits: int):
    """Word hashes of texts, cut to ``bits`` bits (fewer than 64 only to provoke collisions in tests)."""
    whole, start, end, words, first = joined_words(texts)
    return (words if bits >= 64 else mix(words >> _U(64 - bits))), first


def sampled(words: np.ndarray, first: np.ndarray, span: int = SPAN, k: int = K):
    """Stretches of windows with one sample, of many documents at once.

    ``first``: first word of each document, and the end. Returns arrays
    (document, sample hash, hash of all words and the sample's place, start of
    the first window in the document, number of windows).
    """
    none = np.zeros(0, np.int64)
    nothing = (none, none.view(np.uint64), none.view(np.uint64), none, none)
    if len(words) < span:
        return nothing
    edges = mix(rolled(words, k) + _U(0x8EBC6AF09C88C6E3))
    key = (edges & ~_PLACE) | np.arange(len(edges), dtype=np.uint64)
    sample = (_least(key, span - k + 1) & _PLACE).astype(np.int64)
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)[: len(sample)]
    at = np.flatnonzero(np.arange(len(sample)) + span <= first[doc + 1])
    if not len(at):
        return nothing
    doc, sample = doc[at], sample[at]
    new = np.flatnonzero(np.concatenate(([True], (sample[1:] != sample[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.concatenate((new, [len(at)])))
    start, place = at[new], sample[new]
    whole = mix(Stretch(words)(start, start + count + span - 1) + (place - start).astype(np.uint64) * _U(0xA24BAED4963EE407))
    return doc[new], edges[place], whole, start - first[doc[new]], count


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _scan(docs: DataFrame, span: int, k: int, bits: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for begin, texts in byte_batches(batch):
                words, first = _words(texts, bits)
                doc, sample, whole, start, count = sampled(words, first, span, k)
                ends = np.searchsorted(doc, np.arange(len(texts) + 1))
                sha = [hashlib.sha256(b" ".join(t.split()) if t else b"").hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, len(texts)), batch.column(1).slice(begin, len(texts)), pa.array(np.diff(first), pa.int64()), pa.array(sha), _lists(sample.view(np.int64), ends, pa.int64()), _lists(whole.view(np.int64), ends, pa.int64()), _lists(start.astype(np.int32), ends, pa.int32()), _lists(count.astype(np.int32), ends, pa.int32())],
                    ["doc_id", "mark", "n_words", "sha", "sample", "whole", "start", "count"],
                )

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "doc_id long, mark long, n_words long, sha string, sample array<long>, whole array<long>, start array<int>, count array<int>")


def _texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents of ``chosen`` (doc_id, mark, ...) with their texts; one row for each text of an id."""
    return Sieve(chosen, "doc_id").prune(docs, "doc_id").join(chosen, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])


def _walks(rows: DataFrame, span: int, k: int, bits: int) -> DataFrame:
    """(doc_id, mark, begin, nodes): the nodes along each run of neighbouring stretches."""

    def run(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans"))
            for at, texts in byte_batches(batch):
                words, first = _words(texts, bits)
                nodes = rolled(words, k - 1)
                row, begin, out, ends = [], [], [], [0]
                for i in range(len(texts)):
                    found = spans[at + i].values
                    start, count = (found.field(c).to_numpy().astype(np.int64) for c in ("start", "count"))
                    order = np.argsort(start)
                    start, stop = start[order], (start + count)[order] + span - k + 1
                    new = np.flatnonzero(np.concatenate(([True], start[1:] > stop[:-1])))
                    for a, b in zip(start[new].tolist(), stop[np.concatenate((new[1:] - 1, [len(stop) - 1]))].tolist()):
                        row.append(at + i)
                        begin.append(a)
                        out.append(nodes[first[i] + a : first[i] + b])
                        ends.append(ends[-1] + b - a)
                flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
                take = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(begin, pa.int32()), _lists(flat, np.array(ends), pa.int64())], ["doc_id", "mark", "begin", "nodes"])

    return rows.select("doc_id", "mark", "text", "spans").mapInArrow(run, "doc_id long, mark long, begin int, nodes array<long>")


def _graph(edges: DataFrame) -> DataFrame:
    """(u, v, doc_id, walk, i): the edges that several documents have, each with its source coordinate."""
    seen = edges.groupBy("u", "v").agg(F.min(F.struct("doc_id", "walk", "i")).alias("source"), F.max("doc_id").alias("most"))
    return seen.where("source.doc_id < most").select("u", "v", "source.*")


def _compacted(graph: DataFrame) -> DataFrame:
    """(u, v, path, place): the nonbranching path of each edge and its place on it.

    Edges that follow one another at their source and share a node with one edge
    in and one out are one piece. Pieces are chained through such nodes by pointer
    doubling; a ring of pieces stays apart. A path is named by the source
    coordinate of its first edge (walk, i).
    """
    ends = graph.select(F.col("u").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(graph.select(F.col("v").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("n")))
    through = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("n").alias("n")).where("o = 1 and n = 1").select(F.col("node").alias("u"), F.lit(True).alias("through"))
    along = Window.partitionBy("walk").orderBy("i")
    e = graph.join(written(through, "through-nodes"), "u", "left").withColumn("through", F.coalesce("through", F.lit(False)))
    e = e.withColumn("head", ~(F.col("through") & F.coalesce(F.lag("i").over(along) == F.col("i") - 1, F.lit(False))))
    e = written(e.withColumn("at", F.last(F.when(F.col("head"), F.col("i")), True).over(along)), "pieces")
    # One row for each piece that goes on into another, through the node it ends in.
    tails = e.groupBy("walk", "at").agg(F.max(F.struct("i", "v")).alias("end"), F.count("*").alias("length")).select(F.struct("walk", "at").alias("before"), F.col("end.v").alias("u"), "length")
    links = e.where("head and through").select(F.struct("walk", "at").alias("piece"), "u").join(tails, "u").select("piece", "before", "length")
    links, left, last = written(links, "piece-links"), -1, None
    table = links
    while left not in (0, last):  # every round ends some links of every chain: when none ends, what goes on are rings
        last = left
        up = links.select(F.col("piece").alias("before"), F.col("before").alias("top"), F.col("length").alias("more"))
        following = written(links.join(up, "before", "left").select("piece", F.coalesce("top", "before").alias("before"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), F.col("top").isNotNull().alias("going")), "piece-links")
        left = following.where("going").count()
        drop(table)
        table, links = following, following.drop("going")
    if left:  # rings: every piece before which another still stands
        links = links.join(links.select(F.col("piece").alias("before")), "before", "left_anti").select("piece", "before", "length")
    e = e.join(links.select("piece.*", F.col("before"), "length"), ["walk", "at"], "left")
    return e.select("u", "v", F.coalesce("before", F.struct("walk", "at")).alias("path"), (F.col("i") - F.col("at") + F.coalesce("length", F.lit(0))).alias("place"))


def _named_windows(edges: DataFrame, paths: DataFrame, n: int) -> DataFrame:
    """(doc_id, walk, i, name): windows of ``n`` edges all of which repeat.

    The name holds the place of the first edge on its path, and each edge of the
    window where the walk enters a path.
    """
    along = Window.partitionBy("walk").orderBy("i")
    same = (F.lag("path").over(along) == F.col("path")) & (F.lag("place").over(along) == F.col("place") - 1) & (F.lag("i").over(along) == F.col("i") - 1)
    e = edges.join(paths, ["u", "v"]).select("doc_id", "walk", "i", "path", "place")
    e = e.withColumn("turn", F.when(F.coalesce(same, F.lit(False)), F.lit(0).cast("long")).otherwise(F.xxhash64("path", "place")))
    e = e.withColumn("turns", F.bit_xor("turn").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("last", F.lead("i", n - 1).over(along)).withColumn("after", F.lead("turns", n - 1).over(along))
    return e.where(F.col("last") == F.col("i") + (n - 1)).select("doc_id", "walk", "i", F.xxhash64("path", "place", F.col("turns").bitwiseXOR(F.col("after"))).alias("name"))


def _digests(rows: DataFrame) -> DataFrame:
    """(doc_id, mark, start, words, one, two): independent hashes of the words of each stretch asked for in ``asked``."""

    def run(batches):
        for batch in batches:
            asked = batch.column(batch.schema.get_field_index("asked"))
            for at, texts in byte_batches(batch):
                both = [joined_words(texts, seed=s) for s in _CHECKS]
                first, hashed = both[0][4], [Stretch(b[3]) for b in both]
                part = asked.slice(at, len(texts))
                found = part.flatten()
                row = np.repeat(np.arange(len(texts)), np.diff(part.offsets.to_numpy()))
                start, words = (found.field(c).to_numpy().astype(np.int64) for c in ("start", "words"))
                a = first[row] + start
                take = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(words.astype(np.int32)), *[pa.array(h(a, a + words).view(np.int64)) for h in hashed]], ["doc_id", "mark", "start", "words", "one", "two"])

    return rows.select("doc_id", "mark", "text", "asked").mapInArrow(run, "doc_id long, mark long, start int, words int, one long, two long")


def _hashed(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """The digests of stretches (doc_id, mark, start, words)."""
    asked = stretches.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "words")).alias("asked"))
    return _digests(_texts(docs, written(asked, "asked")))


def _kept(rows: DataFrame, span: int, keep_text: bool) -> DataFrame:
    """n_removed, kept_sha256 (and kept_text) of documents with repeated windows."""

    def run(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("spans"))
            for begin, texts in byte_batches(batch):
                removed, sha, kept = [], [], []
                for i, t in enumerate(texts):
                    words = t.split()
                    found = spans[begin + i].values
                    a = found.field("start").to_numpy().astype(np.int64)
                    b = a + found.field("count").to_numpy() + span - 1
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, a, 1)
                    np.add.at(edge, b, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    rest = b" ".join([words[j] for j in np.flatnonzero(stay)])
                    removed.append(int(len(words) - stay.sum()))
                    sha.append(hashlib.sha256(rest).hexdigest())
                    kept.append(rest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), batch.column(1).slice(begin, len(texts)), pa.array(removed, pa.int64()), pa.array(sha), *[pa.array(kept, pa.binary()).cast(pa.string())] * keep_text], ["doc_id", "mark", "n_removed", "kept_sha256", *["kept_text"] * keep_text])

    return rows.select("doc_id", "mark", "text", "spans").mapInArrow(run, "doc_id long, mark long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def _runs(windows: DataFrame, by: list[str], at: str, source: str, keep: list[str | Column]) -> DataFrame:
    """Windows that follow one another, here and at their source, as one span with a count."""
    along = Window.partitionBy(*by, *keep).orderBy(at)
    # In a run, place and source go up together: their difference and the rank's stay the same.
    run = windows.withColumn("_rank", F.row_number().over(along)).withColumn("_here", F.col(at) - F.col("_rank")).withColumn("_there", F.col(source) - F.col(at))
    return run.groupBy(*by, *keep, "_here", "_there").agg(F.min(at).alias(at), F.min(source).alias(source), F.count("*").cast("int").alias("count")).drop("_here", "_there")


def repeated_spans(docs: DataFrame, span: int = SPAN, k: int = K, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(documents scanned, repeated spans).

    ``docs`` has doc_id, mark (hash of the text) and text. A span (doc_id, mark,
    start, count, source_id, source_mark, source_start) says that ``count``
    windows from word ``start`` on stand in the smaller document ``source_id``
    too, from word ``source_start`` on.
    """
    scanned = written(_scan(docs, span, k, bits), "samples")
    stretches = scanned.where("doc_id is not null").select("doc_id", "mark", F.expr("inline(arrays_zip(sample, whole, start, count))"))
    again = stretches.groupBy("sample").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("sample")
    stretches = written(stretches.join(written(again, "repeated-samples"), "sample"), "repeated-stretches")
    # Stretches that are equal as a whole compact to the one in the smallest document.
    first = F.min(F.struct("doc_id", "mark", "start")).alias("source")
    source = written(stretches.groupBy("sample", "whole").agg(first).select("sample", "whole", F.col("source.doc_id").alias("source_id"), F.col("source.mark").alias("source_mark"), F.col("source.start").alias("source_start")), "stretch-sources")
    known = written(stretches.join(source, ["sample", "whole"]), "known-stretches")
    columns = ["doc_id", "mark", "start", "count", "source_id", "source_mark", "source_start"]
    equal = known.where("source_id < doc_id").select(columns)
    # A sample with one stretch does not branch; the others are walked edge by edge.
    forks = source.groupBy("sample").agg(F.count("*").alias("n")).where("n > 1").select("sample")
    own = known.where("source_id = doc_id").join(forks, "sample", "left_semi").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    walks = written(_walks(_texts(docs, written(own, "walked")), span, k, bits).withColumn("walk", F.monotonically_increasing_id()), "walks")
    edges = walks.select("doc_id", "walk", F.posexplode(F.arrays_zip(F.slice("nodes", 1, F.size("nodes") - 1).alias("u"), F.slice("nodes", 2, F.size("nodes") - 1).alias("v"))).alias("i", "e")).select("doc_id", "walk", "i", "e.u", "e.v")
    graph = written(_graph(edges), "graph")
    paths = written(_compacted(graph), "paths")
    drop(graph)
    windows = written(_named_windows(edges, paths, span - k + 1), "windows")
    drop(paths)
    named = windows.groupBy("name").agg(F.min(F.struct("doc_id", "walk", "i")).alias("source"), F.max("doc_id").alias("most")).where("source.doc_id < most")
    named = written(named.select("name", F.col("source.doc_id").alias("source_id"), F.col("source.walk").alias("source_walk"), F.col("source.i").alias("source_i")), "window-sources")
    found = windows.join(named, "name").where("source_id < doc_id").select("walk", "i", "source_walk", "source_i")
    found = _runs(found, ["walk"], "i", "source_i", ["source_walk"])
    here = walks.select("walk", "doc_id", "mark", "begin")
    there = walks.select(F.col("walk").alias("source_walk"), F.col("doc_id").alias("source_id"), F.col("mark").alias("source_mark"), F.col("begin").alias("source_begin"))
    walked = found.join(here, "walk").join(there, "source_walk").select("doc_id", "mark", (F.col("begin") + F.col("i")).alias("start"), "count", "source_id", "source_mark", (F.col("source_begin") + F.col("source_i")).alias("source_start"))
    equal = _runs_of_spans(equal)
    spans = written(equal.select(columns).unionAll(walked.select(columns)), "spans")
    drop(windows)
    return scanned, _verified(docs, stretches, spans, span, columns)


def _runs_of_spans(spans: DataFrame) -> DataFrame:
    """Spans that follow one another, here and at their source, as one."""
    by = ["doc_id", "mark", "source_id", "source_mark"]
    along = Window.partitionBy(*by).orderBy("start", "source_start")
    meets = (F.lag(F.col("start") + F.col("count")).over(along) == F.col("start")) & (F.lag(F.col("source_start") + F.col("count")).over(along) == F.col("source_start"))
    run = spans.withColumn("_new", F.when(F.coalesce(meets, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(along))
    return run.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.min("source_start").alias("source_start"), F.sum("count").cast("int").alias("count"))


def _verified(docs: DataFrame, stretches: DataFrame, spans: DataFrame, span: int, columns: list[str]) -> DataFrame:
    """The spans whose words are those at their source; windows of others are told apart by their words."""
    words = (F.col("count") + (span - 1)).alias("words")
    here = spans.select("doc_id", "mark", "start", words)
    there = spans.select(F.col("source_id").alias("doc_id"), F.col("source_mark").alias("mark"), F.col("source_start").alias("start"), words)
    hashed = written(_hashed(docs, here.unionAll(there).distinct()), "span-hashes")
    own = hashed.withColumnRenamed("one", "a").withColumnRenamed("two", "b")
    far = hashed.select(F.col("doc_id").alias("source_id"), F.col("mark").alias("source_mark"), F.col("start").alias("source_start"), "words", "one", "two")
    both = spans.withColumn("words", words).join(own, ["doc_id", "mark", "start", "words"]).join(far, ["source_id", "source_mark", "source_start", "words"])
    both = written(both.select(*columns, ((F.col("a") == F.col("one")) & (F.col("b") == F.col("two"))).alias("good")), "verified")
    good = both.where("good").select(columns)
    bad = both.where("not good").select("doc_id", "mark", F.col("start").alias("from"), (F.col("start") + F.col("count")).alias("to"))
    if not bad.take(1):
        return good
    # A collision of hashes: every window with one of the samples concerned is named by its words.
    of = stretches.join(bad, ["doc_id", "mark"]).where("start < `to` and start + count > `from`").select("sample").distinct()
    some = stretches.join(written(of, "collided"), "sample", "left_semi")
    each = some.select("doc_id", "mark", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("start"), F.lit(span).alias("words")).distinct()
    each = written(_hashed(docs, each), "collided-windows")
    first = each.groupBy("one", "two").agg(F.min(F.struct("doc_id", "mark", "start")).alias("s"))
    more = each.join(first, ["one", "two"]).where("s.doc_id < doc_id").select("doc_id", "mark", "start", F.lit(1).alias("count"), F.col("s.doc_id").alias("source_id"), F.col("s.mark").alias("source_mark"), F.col("s.start").alias("source_start"))
    return written(good.unionAll(more.select(columns)), "mended-spans")


def substring_dedup(docs: DataFrame, span: int = SPAN, k: int = K, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """One row for each input row: doc_id, n_words, n_removed, kept_sha256 (and kept_text where words went).

    A word goes when a window of ``span`` words over it also starts in a document
    with a smaller id; windows are judged on the input. Windows that repeat only
    inside one document stay. Null and empty texts have no words and the digest
    of nothing. Rows with a null id neither lose words nor are sources. Rows that
    repeat an id are judged each for itself and are not sources for one another.
    Very long texts are read whole; other columns are not read. Every span is
    verified against its source by 128 bits of hashes that the search does not
    use. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    scanned, spans = repeated_spans(docs, span, k, bits)
    each = written(spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "count")).alias("spans")), "document-spans")
    changed = written(_kept(_texts(docs, each), span, keep_text), "kept")
    out = scanned.select("doc_id", "mark", "n_words", "sha").join(changed, ["doc_id", "mark"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *["kept_text"] * keep_text)


def op1_substring_dedup(spark, sf_dir):
    """All documents, judged against all; null ids and texts and repeated rows as in ``substring_dedup``."""
    return substring_dedup(read(spark, sf_dir, "documents"))
