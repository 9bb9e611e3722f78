"""Language identification by nearest centroid.

A text's vector holds the log counts of its hashed byte n-grams (1 to 4), weighed
by inverse document frequency and normalised. Each language has several
centroids, found by spherical k-means over a bounded sample of labelled rows. A
text takes the language of the centroid with the greatest cosine; one that is
farther from it than nearly all training texts by a wide margin is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, doc_hash, read

DIMS = 4096
SIZES = (1, 2, 3, 4)
#: Labelled rows of each language used to fit, about; languages are few.
PER_LANGUAGE = 400
CENTROIDS = 4
#: A text is rejected below this share of a low quantile of the cosines of its language's training texts.
MARGIN, QUANTILE = 0.5, 0.01
SEED = 8
#: Runs of anything but letters and the marks that belong to them.
_GAPS, _PLAIN = regex.compile(r"[^\p{L}\p{M}]+"), re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")
_PART = 1 << 20


def _parts(text: str):
    """Runs of words of the text, each led by what comes before it, cut at gaps about every ``_PART`` characters."""
    gaps = _PLAIN if text.isascii() else _GAPS
    at = 0
    while at < len(text):
        gap = gaps.search(text, at + _PART)
        end = gap.start() if gap else len(text)
        words = gaps.sub(" ", text[at:end].lower()).strip()
        if words and (gaps is _PLAIN or _LETTER.search(words)):
            yield words
        at = end


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed n-grams over the whole text; None without any letter."""
    total, before = None, b" "
    for words in _parts(text):
        data = words.encode() + b" "
        b = np.frombuffer(before + data, np.uint8).astype(np.uint32)
        total = np.zeros(DIMS, np.int64) if total is None else total
        old = len(before) if total.any() else 0  # grams that end there are counted
        x = b
        for n in range(1, max(SIZES) + 1):
            if n > 1:
                x = (x[:-1] << np.uint32(8)) | b[n - 1 :]
            if n in SIZES and len(x):
                h = ((x[max(0, old - n + 1) :] + np.uint32(n * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)) >> np.uint32(20)
                total += np.bincount(h, minlength=DIMS)
        before = (before + data)[-(max(SIZES) - 1) :]
    return total


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows: centroids, unit length
    lang_of: np.ndarray  # language of each centroid
    floor: np.ndarray  # least cosine accepted, of each language

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, cosine and whether rejected, of each row of counts."""
        if not len(self.langs):
            return np.full(len(counts), -1), np.zeros(len(counts)), np.ones(len(counts), bool)
        v = _unit(np.log1p(counts).astype(np.float32) * self.idf)
        cos = v @ self.centroids.T
        best = cos.argmax(1)
        top = np.clip(cos[np.arange(len(best)), best].astype(np.float64), 0, 1)
        lang = self.lang_of[best]
        return lang, top, top < self.floor[lang]


def _unit(v: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the mean's farthest rows; small clusters go."""
    k = min(k, len(v))
    picked = [int(np.argmax(v @ _unit(v.mean(0, keepdims=True))[0]))]
    near = v @ v[picked[0]]
    for _ in range(k - 1):
        # Far from all chosen, but not the single oddest row.
        order = np.argsort(near, kind="stable")
        nxt = int(order[len(order) // 20])
        picked.append(nxt)
        near = np.maximum(near, v @ v[nxt])
    c = v[picked]
    for _ in range(rounds):
        who = (v @ c.T).argmax(1)
        c = _unit(np.stack([v[who == j].mean(0) if (who == j).any() else c[j] for j in range(len(c))]))
    share = np.bincount((v @ c.T).argmax(1), minlength=len(c)) / len(v)
    return c[share >= min(0.05, share.max())]


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS) -> Model:
    """Fit on about ``per_language`` rows of each language, chosen by a hash of the id.

    Rows with null labels or texts are left out. The sample's count vectors, not
    its texts, come to the driver: 8 kB a row.
    """
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    u = F.pmod(doc_hash("doc_id", seed=SEED), F.lit(1 << 30)) / float(1 << 30)
    take = F.lit(False)
    for lang, n in sorted(sizes.items()):
        take = F.when(F.col("lang") == lang, u < per_language / n).otherwise(take)

    def vectors(batches):
        for batch in batches:
            langs = batch.column(1)
            for first, texts in byte_batches(batch):
                got = [gram_counts(t.decode("utf-8", "replace")) for t in texts]
                keep = [i for i, c in enumerate(got) if c is not None]
                yield pa.RecordBatch.from_arrays([pa.array([langs[first + i].as_py() for i in keep], pa.string()), pa.array([np.log1p(got[i]).astype(np.float16).tobytes() for i in keep], pa.binary())], ["lang", "v"])

    got = rows.where(take).select("text", "lang").mapInArrow(vectors, "lang string, v binary").collect()
    got = sorted((r[0], bytes(r[1])) for r in got)
    if not got:
        return Model([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros(0))
    tf = np.stack([np.frombuffer(v, np.float16) for _, v in got]).astype(np.float32)
    names = np.array([lang for lang, _ in got])
    langs = sorted(set(names))
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 0.05).astype(np.float32)
    v = _unit(tf * idf)
    each = [_kmeans(v[names == lang], centroids) for lang in langs]
    c = np.concatenate(each).astype(np.float32)
    who = np.repeat(np.arange(len(langs)), [len(x) for x in each])
    floor = np.array([MARGIN * float(np.quantile((v[names == lang] @ x.T).max(1), QUANTILE)) for lang, x in zip(langs, each)])
    return Model(langs, idf, c, who, floor)


def identify(docs: DataFrame, model: Model, *keep: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, rejected and the columns ``keep`` of each row.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter,
    and where the model knows no language; such rows count as rejected. Whole
    texts are read, whatever their length; equal texts get equal results. Null
    ids and repeated rows are kept; an empty table gives an empty result.
    """
    shape = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(k) for k in keep if k not in ("doc_id", "text")])
    others = [f for f in shape.schema.fields if f.name != "text"]
    with_text = "text" in keep

    def run(batches):
        names = np.array([*model.langs, "und"], object)
        for batch in batches:
            for first, texts in byte_batches(batch, most=1 << 20):
                got = [gram_counts(t.decode("utf-8", "replace")) if t else None for t in texts]
                lang, score, out = np.full(len(got), -1), np.zeros(len(got)), np.ones(len(got), bool)
                rows = [i for i, c in enumerate(got) if c is not None]
                for a in range(0, len(rows), 256):
                    part = rows[a : a + 256]
                    lang[part], score[part], out[part] = model.predict(np.stack([got[i] for i in part]))
                cols = [batch.column(batch.schema.get_field_index(f.name)).slice(first, len(texts)) for f in others]
                if with_text:
                    cols.append(batch.column(1).slice(first, len(texts)))
                yield pa.RecordBatch.from_arrays([*cols, pa.array(names[lang].tolist(), pa.string()), pa.array(score), pa.array(out)], [*[f.name for f in others], *["text"] * with_text, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others) + ", text string" * with_text + ", lang_pred string, score double, rejected boolean"
    return shape.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns.

    Rows without a letter, and rows farther from every centroid than the model's
    margin allows, go. Columns of any name and type pass through unread.
    """
    k = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            array = batch.column(k).cast(pa.binary())
            keep = np.zeros(len(batch), bool)
            one = pa.RecordBatch.from_arrays([array], ["text"])
            for first, texts in byte_batches(one, most=1 << 20):
                got = [gram_counts(t.decode("utf-8", "replace")) if t else None for t in texts]
                rows = [i for i, c in enumerate(got) if c is not None]
                for a in range(0, len(rows), 256):
                    part = rows[a : a + 256]
                    keep[[first + i for i in part]] = ~model.predict(np.stack([got[i] for i in part]))[2]
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def fold(col: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % parts, F.lit(0))


def op8_language_id(spark, sf_dir):
    """All documents, by a model of the rows outside the held-out quarter; texts that are null or have no letter are ``und``."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
