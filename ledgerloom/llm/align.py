"""Alignment of two tokenizers by a dangling-suffix transducer.

Both tokenizers write the same bytes. Reading their tokens side by side, one side
is ahead by a few bytes, always a suffix of its last token: that side and that
suffix are the whole state. The side behind gives the next token; a step from a
state by a token is worked out once and remembered. A group of tokens closes when
nothing dangles, and each step taken while something dangles links the last token
of either side.

Tokens of neither vocabulary go across the start of a word led by one space, so
texts are cut there, and tokens, groups and links of a distinct stretch are worked
out once and remembered while there is room. How many documents hold a linked pair
is counted by Spark: pairs that may be held by many documents, a number bounded by
a parameter, meet their counts by a broadcast, all others by a join.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, drop, fresh, read, slices, written

#: Bytes of stretches and what is known of them that a worker remembers, steps it remembers, and bytes of text aligned at once.
REMEMBERED, STEPS, SLICE = 64 << 20, 200_000, 4 << 20
#: Pairs of ids that are broadcast with their counts at most.
FREQUENT = 1 << 17

_SPACE = 0x20
#: Bytes that start a visible character for certain.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level(entry: str) -> bytes:
    """The bytes of an entry of a byte-level vocabulary: bytes without a visible character stand from U+0100 on, in order."""
    return bytes(_byte_of[c] for c in entry)


_visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_byte_of = {chr(b): b for b in _visible} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_visible)))}


class Byte:
    """Tokens of a byte-level BPE file, special tokens as plain text; texts are read behind a space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            how = json.load(f)
        pre = how.get("pre_tokenizer") or {}
        self.cuts = how.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        special = {t["id"] for t in how.get("added_tokens", ())}
        self.bytes = {i: t.encode() if i in special else byte_level(t) for t, i in self.tokenizer.get_vocab().items()}

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a space."""
        out: list[list[int]] = []
        for a in range(0, len(texts), 1024):
            out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + 1024], add_special_tokens=False)]
        return out


class Piece:
    """Tokens of a sentencepiece model, which itself puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {i: bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1) if texts else []


class Transducer:
    """Steps over states (which side is ahead, and its dangling bytes), each worked out once."""

    def __init__(self, a: dict[int, bytes], b: dict[int, bytes], most: int = STEPS):
        self.bytes, self.most = (a, b), most
        self._clear()

    def _clear(self) -> None:
        #: States by number: 0 has nothing dangling, odd ones have A ahead, even ones B.
        self.number: dict[tuple[int, bytes], int] = {}
        self.state: list[tuple[int, bytes]] = [(1, b"")]
        self.step: list[dict[int, int]] = [{}]
        self.learned = 0

    def _named(self, ahead: int, rest: bytes) -> int:
        if not rest:
            return 0
        if (ahead, rest) not in self.number:
            n = len(self.state)
            n += (n & 1) != (ahead == 0)
            while len(self.state) <= n:
                self.state.append((ahead, rest))
                self.step.append({})
            self.number[ahead, rest] = n
        return self.number[ahead, rest]

    def _learn(self, at: int, token: int) -> int:
        """The state after the side behind has given ``token``; -1 where the bytes differ."""
        ahead, rest = self.state[at]
        more, to = self.bytes[1 - ahead].get(token, b""), -1
        if more and (rest.startswith(more) or more.startswith(rest)):
            to = self._named(ahead, rest[len(more) :]) if len(more) <= len(rest) else self._named(1 - ahead, more[len(rest) :])
        self.step[at][token] = to
        self.learned += 1
        return to

    def run(self, a: list[int], b: list[int]) -> np.ndarray | None:
        """The state after each token; None where the two sides' bytes differ."""
        if self.learned > self.most:
            self._clear()
        step, states, at = self.step, [], 0
        of_a, of_b, took = iter(a).__next__, iter(b).__next__, states.append
        try:
            for _ in range(len(a) + len(b)):
                token = of_b() if at & 1 else of_a()
                to = step[at].get(token)
                if to is None:
                    to = self._learn(at, token)
                if to < 0:
                    return None
                took(to)
                at = to
        except StopIteration:  # the side behind has no more
            return None
        return None if at else np.array(states, np.int64)


def read_out(states: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From the states after each token: how many tokens of A and of B lie before the end of each group, and of each link its token of A and of B (by place)."""
    before = np.concatenate((np.zeros(1, np.int64), states[:-1])) if len(states) else states
    from_b = before & 1
    n_b = np.cumsum(from_b)
    n_a = np.arange(1, len(states) + 1) - n_b
    linked, closed = before != 0, (before != 0) & (states == 0)
    return n_a[closed], n_b[closed], n_a[linked] - 1, n_b[linked] - 1


_PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("m", pa.int32())])


class Aligner:
    """Aligned stretches of text under two vocabularies, the latest ones remembered."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Byte(a), Piece(b)
        self.cuts = self.a.cuts and self.b.cuts
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.size = [self._table(x.bytes) for x in (self.a, self.b)]
        # Each id as it is written in a group: of A before another of A or of B, of B before another of B or a group's end.
        self.said: list[bytes] = [b"%d%c" % (i, c) for x, marks in ((self.a, b",|"), (self.b, b",;")) for c in marks for i in range(max(x.bytes) + 1)]
        self.said_size = np.array([len(x) for x in self.said])
        self._forget()

    @staticmethod
    def _table(tokens: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(max(tokens) + 1, np.int64)
        out[list(tokens)] = [len(t) for t in tokens.values()]
        return out

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.groups = pa.array([], pa.large_binary())
        self.pairs = pa.array([], pa.large_list(pa.int64()))  # a << 32 | b of each link
        self.numbers = np.zeros((0, 4), np.int32)  # tokens of A and B, groups, whether the bytes differ
        self.used, self.turn = np.zeros(0, np.int64), 0

    def _encoded(self, side: int, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches, one after the other, and how many each has."""
        encode = (self.a, self.b)[side].encode
        parts: list = [None] * len(stretches)
        # Stretches that start a word are encoded many in a string, and parted by the bytes that each id stands for.
        led = [i for i, t in enumerate(stretches) if len(t) > 1 and t[0] == _SPACE and _VISIBLE[t[1]] and t[-1] != _SPACE and t[-3:] != b"\xe2\x96\x81"] if self.cuts else []
        for s in range(0, len(led), 2048):
            some = led[s : s + 2048]
            ids = np.array(encode([b"".join([stretches[i] for i in some]).decode("utf-8", "replace")])[0], np.int64)
            ends, marks = np.cumsum(self.size[side][ids]), np.cumsum([len(stretches[i]) for i in some])
            at = np.searchsorted(ends, marks) + 1
            if len(ids) and at[-1] == len(ids) and (ends[at - 1] == marks).all():
                for i, x, y in zip(some, [0, *at[:-1].tolist()], at.tolist()):
                    parts[i] = ids[x:y]
        rest = [i for i, x in enumerate(parts) if x is None]
        for i, found in zip(rest, encode([stretches[i].decode("utf-8", "replace") for i in rest])):
            parts[i] = np.array(found, np.int64)
        return np.concatenate(parts) if parts else np.zeros(0, np.int64), np.array([len(x) for x in parts], np.int64)

    def _differ(self, stretches: list[bytes], ids: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
        """Of which stretches either side's bytes are not the text's."""
        marks = np.cumsum([len(t) for t in stretches])
        raw = b"".join(stretches)
        bad = np.zeros(len(stretches), bool)
        for table, size, own, n in zip((self.a.bytes, self.b.bytes), self.size, ids, counts):
            whole = b"".join([table[i] for i in own.tolist()])
            ends = np.cumsum(n)
            if whole == raw and (np.concatenate(([0], np.cumsum(size[own])))[ends] == marks).all():
                continue
            for k, (x, y) in enumerate(zip(ends - n, ends)):
                bad[k] |= b"".join([table[i] for i in own[x:y].tolist()]) != stretches[k]
        return bad

    def _made(self, stretches: list[bytes]) -> None:
        """Align new stretches and remember them."""
        ids, counts = map(list, zip(*(self._encoded(side, stretches) for side in (0, 1))))
        bad = self._differ(stretches, ids, counts)
        if bad.any():
            ids = [x[np.repeat(~bad, n)] for x, n in zip(ids, counts)]
            counts = [np.where(bad, 0, n) for n in counts]
        (a, b), (n_a, n_b) = ids, counts
        states = self.transducer.run(a.tolist(), b.tolist())
        if states is None:
            raise AssertionError("two sides with the same bytes align")
        group_a, group_b, link_a, link_b = read_out(states, a, b)
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        # Groups and links never go across the end of a stretch.
        groups_at = np.searchsorted(group_a, end_a, "right")
        links_at = np.searchsorted(link_a, end_a)
        of_a, of_b = np.searchsorted(group_a, np.arange(len(a)), "right"), np.searchsorted(group_b, np.arange(len(b)), "right")
        ends = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends[0][group_a - 1], ends[1][group_b - 1] = True, True
        top_a, top_b = len(self.size[0]), len(self.size[1])
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.concatenate(([0], group_b))[of_a]] = a + top_a * ends[0]
        code[np.arange(len(b)) + group_a[of_b]] = b + 2 * top_a + top_b * ends[1]
        text = b"".join([self.said[c] for c in code.tolist()])
        text_at = np.concatenate(([0], np.cumsum(self.said_size[code])))[np.concatenate(([0], end_a + end_b))]
        said = pa.Array.from_buffers(pa.large_binary(), len(stretches), [None, pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(text)])
        pairs = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], links_at))), pa.array(a[link_a] << 32 | b[link_b]))
        numbers = np.stack([n_a, n_b, np.diff(groups_at, prepend=0), bad], 1).astype(np.int32)
        self.known = pa.concat_arrays([self.known, pa.array(stretches, pa.large_binary())])
        self.groups = pa.concat_arrays([self.groups, said])
        self.pairs = pa.concat_arrays([self.pairs, pairs])
        self.numbers = np.concatenate((self.numbers, numbers))
        self.used = np.concatenate((self.used, np.zeros(len(stretches), np.int64)))

    def _at(self, stretches: pa.Array) -> np.ndarray:
        """Where distinct stretches are among the known ones; new ones are aligned first. Of too many, the half not used for longest goes."""
        if self.known.nbytes + self.groups.nbytes + self.pairs.nbytes + self.numbers.nbytes + self.used.nbytes > REMEMBERED:
            half = np.sort(np.argsort(self.used, kind="stable")[len(self.used) // 2 + 1 :])
            keep = pa.array(half)
            self.known, self.groups, self.pairs = (x.take(keep) for x in (self.known, self.groups, self.pairs))
            self.numbers, self.used = self.numbers[half], self.used[half]
        at = pc.fill_null(pc.index_in(stretches, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.known) + np.arange(len(new))
            self._made(stretches.take(pa.array(new)).to_pylist())
        self.turn += 1
        self.used[at] = self.turn
        return at

    def of(self, texts: pa.Array) -> pa.RecordBatch:
        """n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs (with their number) of each text."""
        n = len(texts)
        empty = pc.fill_null(pc.equal(pc.binary_length(texts), 0), True).to_numpy(zero_copy_only=False)
        parts = pc.binary_join_element_wise(pa.scalar(b"", pa.large_binary()), texts.cast(pa.large_binary()).fill_null(b""), pa.scalar(b" ", pa.large_binary()))
        _, ends, data = parts.buffers()
        ends = np.frombuffer(ends, np.int64)[parts.offset : parts.offset + n + 1]
        data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 2:
            cut[1:-2] = (data[1:-1] == _SPACE) & (data[:-2] != _SPACE) & _VISIBLE[data[2:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        units = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data.tobytes())]).dictionary_encode()
        place = self._at(units.dictionary)
        code = units.indices.to_numpy()
        first = np.searchsorted(at, ends)
        doc = np.repeat(np.arange(n), np.diff(first))
        whole = place[code]
        bad = empty | (np.bincount(doc, self.numbers[whole, 3], n) > 0)
        n_a, n_b, n_groups = (np.where(bad, 0, np.bincount(doc, self.numbers[whole, k], n)).astype(np.int64) for k in range(3))

        said = self.groups.take(pa.array(whole))
        said_at = np.frombuffer(said.buffers()[1], np.int64)[: len(said) + 1][first]
        text = memoryview(said.buffers()[2] or b"")
        shas = ["" if z or y <= x else hashlib.sha256(text[x : y - 1]).hexdigest() for z, x, y in zip(bad.tolist(), said_at[:-1].tolist(), said_at[1:].tolist())]

        # Each document's distinct stretches, then their pairs, then distinct pairs.
        good = ~bad[doc]
        key, times = np.unique(doc[good] * max(1, len(place)) + code[good], return_counts=True)
        lists = self.pairs.take(pa.array(place[key % max(1, len(place))]))
        size = np.diff(lists.offsets.to_numpy())
        pair, m, owner = lists.flatten().to_numpy(), np.repeat(times, size), np.repeat(key // max(1, len(place)), size)
        order = np.lexsort((pair, owner))
        pair, m, owner = pair[order], m[order], owner[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])
        start = np.flatnonzero(new)
        m = np.add.reduceat(m, start) if len(start) else m
        pair, owner = pair[start], owner[start]
        pairs = pa.StructArray.from_arrays([pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(m.astype(np.int32))], fields=list(_PAIR))
        listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pairs)
        columns = [pa.array(n_a), pa.array(n_b), pa.array(n_groups), pa.array(n_a + n_b - n_groups), pa.array(shas, pa.string()), listed]
        return pa.RecordBatch.from_arrays(columns, ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 and the distinct linked pairs of each input row."""
    name = f"{a}\n{b}"

    def run(batches):
        if name not in KEPT:
            KEPT[name] = Aligner(a, b)
        align = KEPT[name]
        for batch in batches:
            for first, size in slices(batch, "text", SLICE, keeping=name):
                out = align.of(batch.column(1).slice(first, size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, size), *out.columns], ["doc_id", *out.schema.names])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a:int,b:int,m:int>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n (rows that hold the pair linked) and best (no pair of this ``a`` is held by more) of all linked pairs."""
    counts = written(rows.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")), "pair-counts")
    # A row for each id of A: no more than its vocabulary has.
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, a: str | None = None, b: str | None = None, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` names a byte-level BPE file, ``b`` a sentencepiece model, readable on
    every machine. Null and empty texts, and texts that the two vocabularies do
    not give back byte for byte, have no tokens: zeros and an empty digest.
    Repeated rows each count as a document, null ids are kept, other columns are
    not read. An empty table gives an empty result. Whole texts are aligned
    however long; strings of special tokens are plain text.
    """
    own = default_tokenizers()
    row = fresh("row")
    made = written(aligned(docs, a or own[0], b or own[1], id_col, text_col).withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = written(pair_counts(made), "pair-counts-best")
    # At most ``frequent`` pairs have a count of 1/frequent of the sum of all counts.
    total = counts.agg((F.sum("n") / frequent).alias("least"))
    often = counts.join(F.broadcast(total), F.col("n") >= F.col("least")).drop("least")
    seldom = counts.join(F.broadcast(total), F.col("n") < F.col("least")).drop("least")
    often = written(often, "frequent-pairs")
    links = made.select(row, F.explode("pairs").alias("p")).select(row, "p.a", "p.b", "p.m")
    sums = [F.sum(F.when(F.col("best"), F.col("m")).otherwise(0).cast("long")).alias("n_best"), F.sum(F.col("m") * F.col("n")).alias("count_sum")]
    settled = links.join(F.broadcast(often), ["a", "b"]).groupBy(row).agg(*sums)
    rest = links.join(F.broadcast(often), ["a", "b"], "left_anti").join(seldom, ["a", "b"]).groupBy(row).agg(*sums)
    each = settled.unionAll(rest).groupBy(row).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    out = made.drop("pairs").join(each, row, "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    out = written(out, "alignment")
    drop(made, counts, often)
    return out


def op13_tokenizer_alignment(spark, sf_dir):
    """All documents; null, empty and odd texts as in ``align``."""
    return align(read(spark, sf_dir, "documents"))
