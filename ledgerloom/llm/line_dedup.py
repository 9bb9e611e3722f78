"""Line dedup by range-partitioned hashes and a stream of first occurrences.

Every line that counts becomes a row of hashes: its key's 128 bits, its document
and its place. The rows are dealt by range of (key, document, place), so that even
one very common line lies over many partitions, and sorted inside each partition
with the largest document of a key first. A stream over a partition then knows the
first occurrence of a key and from the third document on that later ones go. Only
a partition's first and last key can go on elsewhere: a few rows a partition say
what each saw of those two keys and settle them by a broadcast. What comes out is
a compressed bitmap of the lines that stay for each document that loses some; the
texts themselves do not take part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Sieve, drop, fresh, read, release, written

#: Code points of a key that counts, and documents that must hold it.
LEAST, DOCUMENTS = 20, 3
_STRIPPED = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id, below all others.
_NONE = -(2**63)
_GONE, _OPEN, _SEEN = 0, 1, 2


def _id(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(_NONE))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """h1, h2, doc_id, mark (hash of the whole text) and place (line number in the upper half, number of lines in the lower) of each line that counts."""
    text = _text(text_col)
    lines = docs.select(_id(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), _lines(text).alias("lines"))
    lines = lines.select("doc_id", "mark", F.size("lines").cast("long").alias("n"), F.posexplode("lines").alias("i", "line"))
    key = F.translate(F.btrim("line", F.lit(_STRIPPED)), _UPPER, _LOWER)
    keys = lines.select("doc_id", "mark", "n", "i", key.alias("key")).where(F.char_length("key") >= least)
    place = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("n"))
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "mark", place.alias("place"))


class _Stream:
    """One range partition in order: which lines go, and what its first and last key leave open."""

    def __init__(self, documents: int):
        self.documents = documents
        self.key: tuple | None = None  # the last key met
        self.first = True  # whether that is the partition's first
        self.seen: list[int] = []  # its first documents, no more than must hold it
        self.held: list[np.ndarray] = []  # its lines behind the first document, while too few hold it

    def _more(self, rows: np.ndarray):
        """Further rows of the last key."""
        for doc in np.unique(rows[2])[::-1][: self.documents].tolist():
            if len(self.seen) < self.documents and doc not in self.seen:
                self.seen.append(doc)
        if self.first:
            yield _OPEN, rows
            return
        self.held.append(rows[:, rows[2] != self.seen[0]])
        if len(self.seen) >= self.documents:
            yield _GONE, np.concatenate(self.held, 1)
            self.held = []

    def _said(self):
        """What was seen of the last key, a row for each document."""
        n = len(self.seen)
        yield _SEEN, np.array([[self.key[0]] * n, [self.key[1]] * n, self.seen, [0] * n, [0] * n], np.int64)

    def batch(self, rows: np.ndarray):
        """``rows`` has h1, h2, doc_id, mark and place as its rows; yields (kind, rows)."""
        if self.key is None:
            self.key = (rows[0, 0], rows[1, 0])
        other = (rows[0] != self.key[0]) | (rows[1] != self.key[1])
        n = int(other.argmax()) if other.any() else len(other)
        if n:
            yield from self._more(rows[:, :n])
        if n == len(other):
            return
        if self.first:
            yield from self._said()
        rows = rows[:, n:]
        h1, h2, doc = rows[:3]
        last = int(((h1 == h1[-1]) & (h2 == h2[-1])).argmax())
        if last:
            yield _GONE, self._inner(rows[:, :last])
        self.key, self.first, self.seen, self.held = (h1[-1], h2[-1]), False, [], []
        yield from self._more(rows[:, last:])

    def _inner(self, rows: np.ndarray) -> np.ndarray:
        """Of keys that lie whole in ``rows``, the lines that go."""
        h1, h2, doc = rows[:3]
        new = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        step = new.copy()
        step[1:] |= doc[1:] != doc[:-1]
        start, group = np.flatnonzero(new), np.cumsum(new) - 1
        rank = np.cumsum(step)
        rank -= (rank[start] - 1)[group]
        total = rank[np.concatenate((start[1:], [len(doc)])) - 1]
        return rows[:, (total >= self.documents)[group] & (rank > 1)]

    def end(self):
        if self.key is not None:
            for rows in self.held:
                yield _OPEN, rows
            yield from self._said()


def _streamed(rows: DataFrame, documents: int) -> DataFrame:
    """The stream over each sorted partition, with the kind of each row that comes out."""
    names = ["h1", "h2", "doc_id", "mark", "place"]

    def run(batches):
        stream = _Stream(documents)

        def out(found):
            for kind, rows in found:
                if rows.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], kind, np.int8)), *map(pa.array, rows)], ["kind", *names])

        for batch in batches:
            if batch.num_rows:
                yield from out(stream.batch(np.stack([c.to_numpy() for c in batch.columns])))
        yield from out(stream.end())

    return rows.select(*names).mapInArrow(run, "kind tinyint, " + ", ".join(f"{n} long" for n in names))


def keep_bitmaps(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document that loses lines: doc_id, mark, n_lines, n_dropped and ``keep``.

    A line's key is the line without ASCII white space at both ends, A-Z in lower
    case. Keys of at least ``least`` code points in at least ``documents``
    documents lose all lines but those of the largest id that holds them. ``keep``
    has a bit for each line, set where it stays, lowest bit first, compressed with
    zlib; ``mark`` is the 64-bit hash of the text, so that rows that repeat an id
    are told apart. Documents that are not listed keep all their lines.

    Rows with one id are one document when documents are counted, and all of them
    keep the lines of which that id is the largest; null ids count as one id below
    all others. Null and empty texts are one empty line, which never counts, and
    an empty table has no bitmaps. A very long text is many rows; other columns
    are not read. Keys are told apart by 128 bits of hashes.
    """
    rows = line_rows(docs, least, id_col, text_col)
    order = ["h1", "h2", F.desc("doc_id"), "mark", "place"]
    verdict = written(_streamed(rows.repartitionByRange(*order).sortWithinPartitions(*order), documents), "line-verdicts")
    # Of two keys a partition, at most ``documents`` rows each: a bound that the number of partitions gives.
    facts = verdict.where(F.col("kind") == _SEEN).groupBy("h1", "h2").agg(F.max("doc_id").alias("most"), F.count_distinct("doc_id").alias("n")).where(F.col("n") >= documents)
    late = verdict.where(F.col("kind") == _OPEN).join(F.broadcast(facts), ["h1", "h2"]).where("doc_id < most")
    gone = verdict.where(F.col("kind") == _GONE).select("doc_id", "mark", "place").unionAll(late.select("doc_id", "mark", "place"))
    listed = gone.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places"))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("places")
            n_lines, n_dropped, keep = [], [], []
            for place in batch.column(at):
                place = place.values.to_numpy()
                bits = np.ones(int(place[0] & 0xFFFFFFFF), bool)
                bits[place >> 32] = False
                n_lines.append(len(bits))
                n_dropped.append(len(place))
                keep.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "mark", "n_lines", "n_dropped", "keep"])

    out = written(listed.mapInArrow(run, "doc_id long, mark long, n_lines long, n_dropped long, keep binary"), "line-bitmaps")
    drop(verdict)
    return out


@F.pandas_udf(StringType())
def _kept_lines(text: pd.Series, keep: pd.Series) -> pd.Series:
    out = []
    for t, k in zip(text, keep):
        if k is not None:
            lines = t.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(lines), bitorder="little")
            t = "\n".join([x for x, b in zip(lines, bits) if b])
        out.append(t)
    release()
    return pd.Series(out, dtype=object)


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with the lines that stay; with ``n_lines`` and ``n_dropped``, columns of these names are added.

    Only texts whose document may have a bitmap move. A null text stays null. A
    document all of whose lines go has an empty text.
    """
    one, mark = fresh("id"), fresh("mark")
    added = [fresh("n"), fresh("dropped")]
    keep = fresh("keep")
    rows = docs.select("*", _id(id_col).alias(one), F.xxhash64(_text(text_col)).alias(mark))
    sieve = Sieve(bitmaps, "doc_id")
    size = F.size(_lines(_text(text_col))).cast("long")
    sure = sieve.prune(rows, one, others=True).select(*docs.columns, size.alias(added[0]), F.lit(0).cast("long").alias(added[1]))
    named = bitmaps.select(F.col("doc_id").alias(one), F.col("mark").alias(mark), F.col("n_dropped").alias(added[1]), F.col("keep").alias(keep))
    maybe = sieve.prune(rows, one).join(named, [one, mark], "left")
    changed = F.coalesce(_kept_lines(F.when(F.col(keep).isNotNull(), F.col(text_col)), F.col(keep)), F.col(text_col))
    texts = [changed.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    maybe = maybe.select(*texts, size.alias(added[0]), F.coalesce(added[1], F.lit(0).cast("long")).alias(added[1]))
    out = sure.unionAll(maybe)
    return out.select(*docs.columns, *[F.col(a).alias(b) for a, b in zip(added, (n_lines, n_dropped)) if b])


def line_dedup(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_lines (before dropping), n_dropped and the SHA-256 of the lines that stay.

    Null and empty texts are one empty line, which stays. See ``keep_bitmaps`` for
    null and repeated ids; an empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bitmaps = keep_bitmaps(docs, least, documents)
    out = apply(docs, bitmaps, n_lines="n_lines", n_dropped="n_dropped")
    return written(out.select("doc_id", "n_lines", "n_dropped", F.sha2(_text("text"), 256).alias("kept_sha256")), "lines-kept")


def op11_line_dedup(spark, sf_dir):
    """Every document's lines, judged against all documents; null ids, null texts and empty tables as in ``line_dedup``."""
    return line_dedup(read(spark, sf_dir, "documents"))
