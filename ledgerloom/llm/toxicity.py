"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, maps look-alike letters and digits that stand for letters to
plain ones, and turns other marks into spaces. Lexicon entries are word
beginnings that mark toxic rows beyond chance, weighed by their log odds in
labelled rows. Exception phrases, a match with the word before or behind it as met
in harmless rows alone, cancel the matches that they cover. The sum of weights is
normalised by the number of words and a logistic curve turns it into a score.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_batches, doc_hash, read
from .langid import fold as split_fold

#: Labelled rows used to fit, about. What they hold bounds the lexicon, the exceptions and all that comes to the driver.
SAMPLE = 8000
#: Least share of toxic training rows that hold an entry, and least share of the rows that hold it that are toxic.
SUPPORT, PRECISION = 0.02, 0.9
SHORTEST, LONGEST = 3, 10
SEED = 9
#: Chance that any entry of the lexicon is noise; harmless rows that make a phrase an exception.
NOISE, HARMLESS = 0.01, 2
#: Digits and signs that stand for letters, and look-alikes of Latin letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
TWINS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ո": "n", "ɡ": "g", "ı": "i",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "χ": "x", "ӏ": "l", "ⅼ": "l", "ℓ": "l", "ѵ": "v", "ԝ": "w",
}
_MAP = {c: " " for c in range(128) if not chr(c).isalnum()} | {ord(a): b for a, b in (SIGNS | TWINS).items()}
_MAP |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_MAP |= {c: " " for c in (0x85, 0xA0, *range(0x2000, 0x200B), *range(0x2010, 0x2030), 0x202F, 0x3000)}


def folded(text: str) -> str:
    """The text with look-alikes folded, between single leading and trailing spaces."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(_MAP)} "


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = -1.0

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for term, w in self.weights.items():
            made.add_word(" " + term, (len(term) + 1, w))
        for phrase in self.exceptions:
            f = " " + " ".join(folded(phrase).split()) + " "
            made.add_word(f, (len(f), None))
        if len(made):
            made.make_automaton()
        return made

    def hits(self, made, text: str) -> tuple[list[tuple[int, int, float]], str]:
        """(start, end, weight) of the matches that no exception covers, and the folded text with single spaces."""
        t = " " + " ".join(folded(text).split()) + " "
        if not len(made):
            return [], t
        found = [(end - size + 1, end, w) for end, (size, w) in made.iter(t)]
        spared = sorted((a, b) for a, b, w in found if w is None)
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))

        def covered(a, b):
            k = bisect_right(starts, a)
            return k > 0 and reach[k - 1] >= b

        return [(a, b, w) for a, b, w in found if w is not None and not covered(a, b)], t

    def weigh(self, made, text: str) -> tuple[float, int]:
        """Sum of the weights matched, and the number of words."""
        found, t = self.hits(made, text)
        return sum(w for *_, w in found), max(0, t.count(" ") - 1) if t.strip() else 0

    def feature(self, total: float, n: int) -> float:
        return total / (1.0 + math.log1p(max(n, 0)))

    def score(self, total: float, n: int) -> float:
        z = self.slope * self.feature(total, n) + self.bias
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    rows = labelled.where("label is not null and text is not null")
    n = rows.count()
    u = F.pmod(doc_hash("doc_id", seed=SEED), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(u < most / max(n, 1))


def _counted(rows: DataFrame, seen_in) -> DataFrame:
    """(term, good, bad): harmless and toxic rows that hold each term of ``seen_in(text)``; the term "" is in all."""

    def run(batches):
        for batch in batches:
            good, bad = Counter(), Counter()
            labels = batch.column(1).to_pylist()
            for first, texts in byte_batches(batch):
                for i, t in enumerate(texts):
                    (bad if labels[first + i] == 1 else good).update(seen_in(t.decode("utf-8", "replace")) | {""})
            keys = sorted(set(good) | set(bad))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([good[k] for k in keys], pa.int64()), pa.array([bad[k] for k in keys], pa.int64())], ["term", "good", "bad"])

    return rows.select("text", "label").mapInArrow(run, "term string, good long, bad long").groupBy("term").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def _beginnings(text: str) -> set[str]:
    return {w[:k] for w in set(folded(text).split()) for k in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _beyond_chance(good: int, bad: int, base: float, tried: int) -> bool:
    """Whether so many toxic rows among those that hold a term are no accident of ``tried`` terms (Chernoff's bound)."""
    n, p = good + bad, bad / (good + bad)
    if p <= base:
        return False
    gain = p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0)
    return n * gain > math.log(max(tried, 1) / NOISE)


def _entries(found: dict[str, tuple[int, int]], n_good: int, n_bad: int) -> dict[str, float]:
    """The lexicon from (harmless rows, toxic rows) of the word beginnings that may be entries."""
    base = n_bad / max(1, n_good + n_bad)
    some = {t: c for t, c in found.items() if c[1] >= SUPPORT * n_bad and _beyond_chance(*c, base, len(found))}
    longer: dict[str, list[str]] = {}
    for t in some:
        longer.setdefault(t[:-1], []).append(t)
    full = set()
    for t in some:  # a beginning that nearly always goes on in one way goes on
        while more := [x for x in longer.get(t, ()) if some[x][1] >= 0.9 * some[t][1]]:
            t = max(more, key=lambda x: (some[x][1], x))
        full.add(t)
    kept: dict[str, float] = {}
    for t in sorted(full, key=lambda t: (len(t), t)):
        if not any(t[:k] in kept for k in range(SHORTEST, len(t))):
            good, bad = some[t]
            kept[t] = math.log((bad + 0.5) / (n_bad + 1)) - math.log((good + 0.5) / (n_good + 1))
    return kept


def fit(labelled: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """Learn the lexicon and its exceptions from (doc_id, text, label 0/1); ``exceptions`` are given ones besides.

    About ``sample`` rows are used, chosen by a hash of the id; rows with a null
    label or text are left out. Word beginnings and phrases are counted on the
    executors; only those that may be entries come to the driver. Without toxic
    rows, the lexicon is empty and all scores are low.
    """
    rows = _sample(labelled, sample)
    counts = _counted(rows, _beginnings)
    none, likely = F.col("term") == "", (F.col("bad") >= 3) & (F.col("bad") >= PRECISION * (F.col("good") + F.col("bad")))
    found = {r["term"]: (r["good"], r["bad"]) for r in counts.where(none | likely).collect()}
    n_good, n_bad = found.pop("", (0, 0))
    lexicon = Lexicon(_entries(found, n_good, n_bad), tuple(exceptions))
    if lexicon.weights:

        def phrases(text: str, kept: list = []) -> set[str]:  # noqa: B006: one automaton a worker
            if not kept:
                kept.append(lexicon.automaton())
            hits, t = lexicon.hits(kept[0], text)
            out = set()
            for a, _, _ in hits:
                here = t[a + 1 : t.index(" ", a + 1)]
                end = a + 1 + len(here)
                before, after = t[t.rfind(" ", 0, a) + 1 : a], t[end + 1 : max(end + 1, t.find(" ", end + 1))]
                out |= {x for x in (f"{before} {here}" if before else "", f"{here} {after}" if after else "") if x}
            return out

        spared = _counted(rows, phrases).where((F.col("term") != "") & (F.col("bad") == 0) & (F.col("good") >= HARMLESS)).select("term")
        lexicon.exceptions += tuple(sorted(r["term"] for r in spared.collect()))

    def weighed(batches):
        made = lexicon.automaton()
        for batch in batches:
            out = []
            for _, texts in byte_batches(batch):
                out += [lexicon.feature(*lexicon.weigh(made, t.decode("utf-8", "replace"))) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(1).cast(pa.int64())], ["x", "y"])

    got = sorted((r[0], r[1]) for r in rows.select("text", "label").mapInArrow(weighed, "x double, y long").collect())
    if got and n_bad:
        lexicon.slope, lexicon.bias = _logistic(np.array([g[0] for g in got]), np.array([g[1] for g in got], float))
    return lexicon


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small ridge."""
    a, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, weight and n_words of each row.

    Null and empty texts have weight 0 and the score of no match. Very long texts
    are read whole, in time in proportion to their length. Null ids and repeated
    rows are kept; other columns are not read. An empty table gives an empty result.
    """

    def run(batches):
        made = lexicon.automaton()
        for batch in batches:
            for first, texts in byte_batches(batch):
                got = [lexicon.weigh(made, t.decode("utf-8", "replace") if t else "") for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array([lexicon.score(*g) for g in got], pa.float64()), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())], ["doc_id", "score", "weight", "n_words"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, weight double, n_words long")


def op9_toxicity(spark, sf_dir):
    """All documents, scored by a lexicon of the labelled rows outside the held-out fifth; null ids and texts as in ``score``."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    labelled = docs.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").cast("int").alias("label")).where("label is not null"), "doc_id").where(split_fold("doc_id", 5) != 0)
    lexicon = fit(labelled)
    out = score(docs, lexicon)
    return out.select("doc_id", (split_fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
