"""Packing documents into fixed windows by minimum bin slack.

A document's ids are cut into full windows, each a sequence of its own without
padding, and one tail. Only the number of tails of each length (at most
``window - 1`` numbers) reaches the driver. There, the longest tail left opens a
window and a bitset subset-sum over the lengths left finds the multiset that
fills it closest to capacity; the counts found by backtracking are used for as
many windows as the lengths left allow. Tails are then numbered by length in a
fixed order and take the places that the patterns gave to their length.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEPT, doc_hash, place_of_null, read, slices, written

WINDOW = 2048
END = 1
SEED = 41
#: Bytes of units and their ids that a worker remembers, and bytes of text encoded at once.
REMEMBERED, SLICE = 32 << 20, 8 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Bytes that start a visible character for certain; others never start a unit.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


class Ids:
    """Token ids (little-endian 32-bit) of texts under a vocabulary file, by ``tokenizers``.

    Under a plain byte-level pre-tokenizer a space before a visible character
    always starts a new token, so the units between such spaces have the same ids
    alone as in the whole text. Texts are cut there on their bytes, equal units
    become one entry of an Arrow dictionary, and only entries not remembered are
    encoded. Texts that hold the string of an added token, and all texts under
    another pre-tokenizer, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        how = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and how.get("type") == "ByteLevel" and not how.get("add_prefix_space") and how.get("use_regex", True)
        self.added = [t["content"].encode() for t in made.get("added_tokens", ())]
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes that each id stands for
        self.lengths[list(vocab.values())] = [len(t) for t in vocab]
        self.known = pa.array([], pa.large_binary())
        self.ids = pa.array([], pa.large_binary())
        self.used, self.turn = np.zeros(0, np.int64), 0

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for a in range(0, len(texts), 256):
            part = [t.decode("utf-8", "replace") for t in texts[a : a + 256]]
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _encode_led(self, units: list[bytes]) -> list[bytes]:
        """Ids of units led by a space: many in one string, parted again by the bytes that each id stands for."""
        out: list[bytes] = []
        for a in range(0, len(units), 2048):
            part = units[a : a + 2048]
            marks = np.cumsum([len(u) for u in part])
            try:
                ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            except UnicodeDecodeError:
                ids = np.zeros(0, "<u4")
            ends = np.cumsum(self.lengths[ids])
            at = np.searchsorted(ends, marks) + 1
            if len(ids) and at[-1] == len(ids) and (ends[at - 1] == marks).all():
                raw = ids.tobytes()
                out += [raw[x:y] for x, y in zip([0, *(4 * at[:-1]).tolist()], (4 * at).tolist())]
            else:  # bytes that are not UTF-8
                out += self._encode(part)
        return out

    def _units(self, units: pa.Array) -> pa.Array:
        """The ids of distinct units: looked up in the arrays of known ones, or encoded."""
        at = pc.fill_null(pc.index_in(units, value_set=self.known), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        if len(new):
            lacking = units.take(pa.array(new))
            texts = lacking.to_pylist()
            led = [u for u in texts if u[:1] == b" " and len(u) > 1 and _VISIBLE[u[1]]]
            got = dict(zip(led, self._encode_led(led)))
            other = [u for u in texts if u not in got]
            got.update(zip(other, self._encode(other)))
            at = at.astype(np.int64)
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, lacking])
            self.ids = pa.concat_arrays([self.ids, pa.array([got[u] for u in texts], pa.large_binary())])
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
        self.turn += 1
        self.used[at] = self.turn
        out = self.ids.take(pa.array(at))
        if self.known.nbytes + self.ids.nbytes > REMEMBERED:  # the half that was not used for longest goes
            half = pa.array(np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 :]))
            self.known, self.ids, self.used = self.known.take(half), self.ids.take(half), self.used[half.to_numpy()]
        return out

    def of(self, texts: pa.Array) -> list:
        """The ids of each text (binary; null is empty), as buffers."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        if not self.cuts:
            return self._encode(texts.to_pylist())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        cut = np.zeros(len(data) + 1, bool)
        cut[:-2] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        cut[ends[1:][ends[1:] > 0] - 1] = False  # a text's last space has no follower
        cut[ends] = True
        at = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        ids = self._units(units.dictionary).take(units.indices)
        whole = memoryview(ids.buffers()[2] or b"")
        places = np.frombuffer(ids.buffers()[1], np.int64)[: len(ids) + 1][np.searchsorted(at, ends)] if len(ids) else np.zeros(len(ends), np.int64)
        out: list = [whole[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        if any(bytes(data).find(s) >= 0 for s in self.added):
            some = [i for i, t in enumerate(texts.to_pylist()) if any(s in t for s in self.added)]
            for i, found in zip(some, self._encode([texts[i].as_py() for i in some])):
                out[i] = found
        return out


def ids_of(path: str) -> Ids:
    if path not in KEPT:
        KEPT[path] = Ids(path)
    return KEPT[path]


def tokenized(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, doc_tokens and the CRC-32 of each piece (full windows, then the tail); with ``keep_ids`` also all ids."""
    stop = end.to_bytes(4, "little")
    span = 4 * window

    def run(batches):
        encode = ids_of(tokenizer)
        for batch in batches:
            for first, size in slices(batch, "text", SLICE, keeping=tokenizer):
                n, crcs, kept = [], [], []
                for ids in encode.of(batch.column(1).slice(first, size)):
                    n.append(len(ids) // 4 + 1)
                    found = [zlib.crc32(ids[a : a + span]) for a in range(0, len(ids) + 1, span)]
                    found[-1] = zlib.crc32(stop, found[-1])
                    crcs.append(found)
                    if keep_ids:
                        kept.append(bytes(ids) + stop)
                columns = [batch.column(0).slice(first, size), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * keep_ids, ["doc_id", "doc_tokens", "crcs"] + ["ids"] * keep_ids)

    schema = "doc_id long, doc_tokens long, crcs array<long>" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def fill(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """Patterns [(number of windows, {length: uses in each})] that use up all counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    out = []
    while order:
        first = order[0]
        left[first] -= 1
        need = window - first
        bits, steps, goal = 1, [], 1 << need
        full = (goal << 1) - 1
        for n in order:
            if n > need or not left[n]:
                continue
            most, k = min(left[n], need // n), 1
            while most:
                k = min(k, most)
                steps.append((n, k, bits))
                bits |= (bits << (n * k)) & full
                most -= k
                k *= 2
            if bits & goal:
                break
        total = bits.bit_length() - 1
        used = {first: 1}
        for n, k, before in reversed(steps):
            if not total:
                break
            if not (before >> total) & 1:
                used[n] = used.get(n, 0) + k
                total -= n * k
        left[first] += 1
        times = min(left[n] // u for n, u in used.items())
        for n, u in used.items():
            left[n] -= u * times
        out.append((times, used))
        order = [n for n in order if left[n]]
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first window, uses in a window, offset) of each length in each pattern."""
    out, rank, window = [], {}, 0
    for times, used in patterns:
        offset = 0
        for n in sorted(used, reverse=True):
            u = used[n]
            a = rank.get(n, 0)
            out.append((n, a, a + u * times, window, u, offset))
            rank[n] = a + u * times
            offset += u * n
        window += times
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END, keep_ids: bool = False, groups: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids`` if asked for).

    Each id of each document, and the closing id ``end``, lies in exactly one
    piece. A null or empty text is the closing id alone. Repeated rows are packed
    as often as they come; null ids are kept, spread by their place in the table. An empty table gives no pieces. The
    vocabulary file named by ``tokenizer`` must be readable on every machine.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    rows = tokenized(docs, path, window, end, keep_ids, id_col, text_col)
    rows = written(rows.withColumn("place", place_of_null("doc_id")), "tokens")
    rows = rows.withColumn("tail", (F.col("doc_tokens") % window).cast("int")).withColumn("full", F.floor(F.col("doc_tokens") / window).cast("int"))
    counts = {r[0]: r[1] for r in rows.where("tail > 0").groupBy("tail").agg(F.count("*")).collect()}
    patterns = fill(counts, window)
    n_tails = sum(times for times, _ in patterns)
    total = max(1, sum(counts.values()))
    # Both tables are bounded by the window and ``groups``, not by the input.
    dealt = spark.createDataFrame([(n, -(-c * groups // total)) for n, c in counts.items()] or [(0, 1)], "tail int, parts int")
    spots = spark.createDataFrame(places(patterns) or [(0, 0, 0, 0, 1, 0)], "spot int, a long, b long, first_window long, uses int, base int")
    order = ["doc_id", "doc_tokens", "crcs"]
    tails = rows.where("tail > 0").join(F.broadcast(dealt), "tail").withColumn("part", F.pmod(doc_hash("doc_id", "place", seed=SEED), F.col("parts")).cast("int"))
    upto = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = tails.groupBy("tail", "part").agg(F.count("*").alias("n")).select("tail", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    tails = tails.withColumn("k", F.row_number().over(Window.partitionBy("tail", "part").orderBy(*order))).join(F.broadcast(first), ["tail", "part"])
    tails = tails.withColumn("rank", F.col("before") + F.col("k") - 1)
    tails = tails.join(F.broadcast(spots), (F.col("tail") == F.col("spot")) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b")))
    r = F.col("rank") - F.col("a")
    start = (F.col("full") * window).cast("long")
    tails = tails.select(
        "doc_id",
        start.alias("start"),
        F.col("tail").cast("long").alias("length"),
        F.element_at("crcs", -1).alias("ids_crc32"),
        "doc_tokens",
        (F.col("first_window") + F.floor(r / F.col("uses"))).alias("sequence_id"),
        (F.col("base") + (r % F.col("uses")) * F.col("tail")).cast("long").alias("offset"),
        *([F.expr(f"substring(ids, full * {4 * window} + 1, tail * 4)").alias("ids")] * keep_ids),
    )
    whole = rows.where("full > 0").withColumn("part", F.pmod(doc_hash("doc_id", "place", seed=SEED + 1), F.lit(groups)).cast("int"))
    behind = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = whole.groupBy("part").agg(F.sum("full").alias("n")).select("part", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("before"))
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.withColumn("own", F.coalesce(F.sum("full").over(own), F.lit(0))).join(F.broadcast(first), "part")
    whole = whole.select("*", F.posexplode(F.slice("crcs", 1, F.col("full"))).alias("i", "crc")).select(
        "doc_id",
        (F.col("i") * window).cast("long").alias("start"),
        F.lit(window).cast("long").alias("length"),
        F.col("crc").alias("ids_crc32"),
        "doc_tokens",
        (F.lit(n_tails) + F.col("before") + F.col("own") + F.col("i")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *([F.expr(f"substring(ids, i * {4 * window} + 1, {4 * window})").alias("ids")] * keep_ids),
    )
    return tails.unionAll(whole)


def op10_packing(spark, sf_dir):
    """All documents; null and empty texts are a closing id alone, null ids and repeated rows as in ``pack``."""
    return pack(read(spark, sf_dir, "documents"))
