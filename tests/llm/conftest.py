import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASH = ["mark", "size", "shard", "part", "tail", "full", "node", "label", "key", "pattern", "_hash", "text_sha256", "keep_id", "group_size", "score", "rejected", "_id", "_row", "block", "chunk", "unit", "copies"]


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def made(seed=1):
    """Texts with exact and near copies, shared passages, empties, a very long one and odd white space."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    passage = words(rng, 70, vocabulary)
    texts = [words(rng, n, vocabulary) for n in (5, 4, 3, 8, 9, 12, 16, 18, 25, 40, 60, 80, 120, 300, 300, 700)]
    for t in list(texts):
        w = t.split()
        texts.append(t)  # exact copy
        for share in (0.02, 0.05):
            c = [rng.choice(vocabulary) if rng.random() < share else x for x in w]
            texts.append(" ".join(c))
        texts.append(" ".join(w[: len(w) // 2]) + " " + passage + " " + " ".join(w[len(w) // 2 :]))
        texts.append(" ".join(w[1:]))
    texts += [passage, passage.upper(), passage.replace(" ", "\t\n"), "", "   ", None, None, "1 2 3!", "café слово \U0001f600", "spam " * 300, "spam " * 200, words(rng, 9000, vocabulary)]
    return texts


@pytest.fixture(scope="session")
def rows():
    texts = made()
    random.Random(2).shuffle(texts)
    out = [(3 * i + 1, t, None if i % 17 == 0 else "xy"[i % 2], None if i % 11 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
