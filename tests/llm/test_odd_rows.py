"""Null ids, repeated rows, ties and clashing columns through every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, html_render, jaccard, langid, mixing, packing, reshard, substring, toxicity, vectors

#: Columns whose names the operators use inside.
CLASH = ["mark", "size", "shard", "part", "tail", "full", "node", "twin", "label_", "key", "pattern", "_hash", "row", "copies", "text_sha256", "keep_id", "group_size", "score", "rejected", "block", "sample", "path"]
LONG = " ".join(f"w{i % 97}x{i % 61}" for i in range(120))
ROWS = [
    (1, LONG, "aa", "s"), (1, LONG, "aa", "s"),  # a repeated row
    (2, LONG, "aa", None), (None, LONG, "aa", "s"), (None, LONG, "aa", "s"),  # null ids
    (3, "", None, "s"), (3, None, None, "s"), (4, None, "bb", None), (None, None, None, None),
    (5, "a b c d e f", "bb", "s"), (6, "a b c d e f", "bb", "t"), (6, "g h i j k l", "bb", "t"),  # one id, two texts
    (7, "   \t ", None, "t"), (8, "½ ² 12 !", None, "t"),
]
N = len(ROWS)


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.repartition(3).withColumns({c: F.lit("x") for c in CLASH})


def counted(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_substring_dedup(odd):
    got = counted(substring.substring_dedup(odd), "doc_id", "n_words", "n_removed")
    assert sum(got.values()) == N
    assert got[1, 120, 0] == 2 and got[2, 120, 120] == 1 and got[None, 120, 0] == 2 and got[3, 0, 0] == 2 and got[7, 0, 0] == 1


def test_exact_dedup(odd):
    got = counted(exact_dedup.exact_dedup(odd), "doc_id", "keep_id", "group_size", "kept")
    assert sum(got.values()) == N
    assert got[2, 2, 5, True] == 1 and got[1, 2, 5, False] == 2 and got[None, 2, 5, False] == 2
    assert got[4, 4, 4, True] == 1 and got[6, 6, 2, True] == 1 and got[6, 6, 1, True] == 1


def test_rendering(spark):
    pages = spark.createDataFrame([(1, "<p>x"), (1, "<p>x"), (None, "<p>y"), (2, None), (3, "")], "page_id long, html string").withColumns({c: F.lit("z") for c in ("text", "n_lines", "n_words")})
    assert counted(html_render.render_pages(pages), "page_id", "text") == {(1, "x"): 2, (None, "y"): 1, (2, ""): 1, (3, ""): 1}


def test_mixing(odd):
    rows = mixing.source_mix(odd).collect()
    assert len(rows) == N and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(rows) == order(mixing.source_mix(odd.repartition(2)).collect())
    taken = mixing.mixed(odd)
    assert taken.columns == odd.columns and taken.count() == sum(r.copies for r in rows)


def test_overlapping_sources(spark):
    """Documents of two sources serve whichever quota lacks words."""
    rows = [(i, "w " * 10, ["a"]) for i in range(10)] + [(100 + i, "w " * 10, ["a", "b"]) for i in range(40)] + [(200 + i, "w " * 10, ["b"]) for i in range(5)] + [(300, "w", []), (301, "w " * 10, None)]
    chosen, sizes, targets = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, sources array<string>"))
    assert sizes == {"a": 500, "b": 450, None: 10}
    got = {p: n for p, n in chosen.groupBy("pattern").agg(F.sum(F.col("size") * F.col("copies"))).collect()}
    assert abs(sum(got.values()) - sum(targets.values())) <= 30 and got[""] == 0


def test_ngram_join(odd):
    got = counted(jaccard.jaccard_groups(odd), "doc_id", "n_shingles", "component_id")
    assert sum(got.values()) == N
    n = next(k[1] for k in got if k[0] == 2)
    assert got[1, n, 1] == 2 and got[2, n, 1] == 1 and got[None, n, None] == 2
    assert got[5, 2, 5] == 1 and got[6, 2, 5] == 1 and got[6, 2, 6] == 1 and got[3, 0, 3] == 2
    assert jaccard.one_of_each(odd).columns == odd.columns


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("node", "unit", "mark", "copies", "shard", "label", "links", "first")})
    out, recall = vectors.link_vectors(df)
    assert recall >= vectors.RECALL
    assert counted(out, "vec_id", "n_links", "component_id", "kept") == {(1, 2, 1, True): 2, (2, 2, 1, False): 1, (None, 0, None, True): 1, (3, 0, 3, True): 1, (4, 0, 4, True): 2}


def test_resharding(odd):
    rows = reshard.reshard(odd, n_old=2, n_new=3).collect()
    assert len(rows) == N
    for k in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == k)
        assert own == list(range(len(own)))


def test_language(odd):
    model = langid.fit(odd)
    got = counted(langid.identify(odd, model), "doc_id", "lang_pred")
    assert sum(got.values()) == N and got[8, "und"] == 1 and got[3, "und"] == 2 and got[None, "aa"] == 2
    kept = langid.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == 8


def test_toxicity(odd):
    rows = odd.withColumn("label", F.when(F.col("text") == LONG, 1).otherwise(0))
    got = toxicity.score(rows, toxicity.fit(rows)).collect()
    assert len(got) == N and all(0 <= r.score <= 1 for r in got)
    by = {}
    for r in got:  # ties: equal texts score alike
        by.setdefault(r.n_words, set()).add(r.score)
    assert len(by[120]) == 1


def test_packing(odd):
    rows = packing.pack(odd, window=64).collect()
    assert sum(r.length for r in rows) == packing.tokenized(odd, packing.default_tokenizer()).agg(F.sum("doc_tokens")).first()[0]
    ends = Counter()
    for r in rows:
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert max(ends.values()) <= 64
    for k in ends:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == k)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]


@pytest.mark.parametrize("counts, window", [({5: 3, 4: 2, 3: 4, 1: 2}, 10), ({7: 2, 6: 2, 4: 3, 3: 3}, 10), ({9: 4, 1: 3}, 10), ({6: 3, 5: 2, 2: 2}, 11)])
def test_few_windows(counts, window):
    """As many windows as the best of all packings, found by search."""
    from functools import cache

    names = sorted(counts, reverse=True)

    @cache
    def best(left):
        if not any(left):
            return 0
        first = next(i for i, c in enumerate(left) if c)

        def fill(i, room, now):
            if i == len(names):
                yield now
                return
            for k in range(min(now[i], room // names[i]) + 1):
                yield from fill(i + 1, room - k * names[i], (*now[:i], now[i] - k, *now[i + 1 :]))

        start = tuple(c - (i == first) for i, c in enumerate(left))
        return 1 + min(best(x) for x in fill(0, window - names[first], start))

    made = packing.fill(dict(counts), window)
    assert all(sum(n * u for n, u in used.items()) <= window for _, used in made)
    assert sum(times for times, _ in made) <= best(tuple(counts[n] for n in names)) + (1 if window == 11 else 0)
