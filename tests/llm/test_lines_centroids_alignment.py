"""Line dedup, centroid clustering and tokenizer alignment against plain programs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import align, centroids, line_dedup

CLASH = ["h1", "h2", "mark", "place", "keep", "kind", "places", "line", "n_lines", "n_dropped", "row", "pairs", "n_a", "v", "z", "cluster", "distance", "inertia", "c", "most"]
COMMON = "The very common line of every document"


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- lines -----------------------------------------------------------------


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def plain_lines(rows, least=20, documents=3):
    holders = defaultdict(set)
    ids = [-(2**63) if i is None else i for i, _ in rows]
    for i, (_, t) in zip(ids, rows):
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                holders[key(x)].add(i)
    out = Counter()
    for i, (own, t) in zip(ids, rows):
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(holders[key(x)]) < documents or max(holders[key(x)]) == i]
        out[own, len(lines), len(lines) - len(stay), sha("\n".join(stay))] += 1
    return out


def texts_of_lines():
    rng = random.Random(5)
    pool = [" ".join(rng.choice(["alpha", "Beta", "gamma", "ÄÖ", "delta"]) for _ in range(rng.randint(2, 6))) for _ in range(40)]
    pool += ["exactly twenty chars", "only nineteen chars", "ß" * 20, "ß" * 19, ""]
    rows = []
    for i in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 12))] + [rng.choice(["  ", "\t", ""]) + COMMON.upper() + rng.choice([" ", "\r", "\x0b"])] * rng.randint(0, 3)
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(5, rows[5][1]), (6, "other\n" + COMMON), (None, COMMON), (None, COMMON), (None, COMMON + "\n" + pool[0]), (None, None), (200, None), (201, ""), (202, "\n"), (203, "\n\n" + "x" * 200_000 + "\n"), (204, (COMMON + "\n") * 20_000)]
    return rows


@pytest.fixture(scope="module")
def lines(spark):
    rows = texts_of_lines()
    return rows, clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_lines(lines):
    rows, df = lines
    got = Counter(map(tuple, line_dedup.line_dedup(df).collect()))
    assert got == plain_lines(rows)
    assert Counter(map(tuple, line_dedup.line_dedup(df, least=5, documents=2).collect())) == plain_lines(rows, 5, 2)


def test_bitmaps_and_texts(lines):
    rows, df = lines
    maps = line_dedup.keep_bitmaps(df)
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), count=r["n_lines"], bitorder="little")
        assert (bits == 0).sum() == r["n_dropped"] > 0
    out = line_dedup.apply(df, maps)
    assert out.columns == df.columns
    got = Counter((r["doc_id"], sha(r["text"] or "")) for r in out.select("doc_id", "text").collect())
    want = Counter()
    for (i, _, _, s), n in plain_lines(rows).items():
        want[i, s] += n
    assert got == want
    assert out.where("text is null").count() == 2


def test_one_line_over_many_partitions(spark):
    """A line of a third of all rows lies over many range partitions and is judged as one."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, COMMON).otherwise(F.concat(F.lit("a line of its own, number "), F.col("id").cast("string"))).alias("text"))
    order = ["h1", "h2", F.desc("doc_id"), "mark", "place"]
    dealt = line_dedup.line_rows(df, 20, "doc_id", "text").repartitionByRange(24, *order)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3000 / 8
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        rows = line_dedup.line_dedup(df).where("n_dropped > 0").agg(F.count("*"), F.max("doc_id")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(rows) == (999, 2994)


@pytest.mark.parametrize("seed", range(30))
def test_stream_whatever_the_cuts(seed):
    """Any cuts into partitions and batches give what the whole gives."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    rows = np.stack([rng.integers(0, 3, n), rng.integers(0, 2, n), rng.integers(0, 6, n), np.zeros(n, np.int64), np.arange(n)])
    rows = rows[:, np.lexsort((rows[4], rows[3], -rows[2], rows[1], rows[0]))]
    holders = defaultdict(set)
    for a, b, d, _, _ in rows.T:
        holders[a, b].add(d)
    want = {int(p) for a, b, d, _, p in rows.T if len(holders[a, b]) >= 3 and d < max(holders[a, b])}
    cuts = np.sort(rng.integers(0, n + 1, 3))
    gone, late, seen = set(), [], defaultdict(set)
    for part in np.split(rows, cuts, axis=1):
        stream = line_dedup._Stream(3)
        found = []
        for batch in np.split(part, np.sort(rng.integers(0, part.shape[1] + 1, 3)), axis=1):
            if batch.shape[1]:
                found += stream.batch(batch)
        for kind, r in [*found, *stream.end()]:
            for a, b, d, _, p in r.T:
                if kind == line_dedup._GONE:
                    gone.add(int(p))
                elif kind == line_dedup._OPEN:
                    late.append((a, b, d, int(p)))
                else:
                    seen[a, b].add(d)
    gone |= {p for a, b, d, p in late if len(seen[a, b]) >= 3 and d < max(seen[a, b])}
    assert gone == want


def test_no_lines(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_dedup(none).collect() == [] and line_dedup.keep_bitmaps(none).collect() == []


# ---- centroids -------------------------------------------------------------


def plain_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    now = [v for _, _, v in sorted((sha("1:" + ("" if i is None else str(i))), n, v) for n, (i, v) in enumerate(kept))][:k]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        now = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(now)]
    got = [(i, *nearest(v)) for i, v in kept]
    each = Counter()
    for _, d, j in got:
        each[j] += d
    return Counter((i, j, d, each[j], sum(each.values()), sha(",".join(map(str, now[j])))) for i, d, j in got)


def vectors(seed, n=300, spread=0.3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(9, 64))
    return [(i, (middles[rng.integers(9)] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_centroids(spark, spread):
    rows = vectors(3, spread=spread)
    twin = [0.5] * 64
    rows += [(1000 + i, twin) for i in range(60)] + [(2000, None), (2001, []), (2002, twin[:63]), (2003, twin + [1.0]), (2004, twin[:63] + [None]), (2005, twin[:63] + [float("nan")]), (2006, twin[:63] + [float("inf")]), (None, twin), (7, rows[7][1]), (3000, [-0.01] * 64), (3001, [0.0] * 64)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4))
    assert Counter(map(tuple, centroids.cluster(df).collect())) == plain_clusters(rows)


def test_few_vectors_and_none(spark):
    rows = vectors(4, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, centroids.cluster(df).collect())) == plain_clusters(rows)
    assert centroids.cluster(df.limit(0)).collect() == []
    huge = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [0.0] * 64)], df.schema)
    got = {r["vec_id"]: r for r in centroids.cluster(huge, centroids=1, rounds=0).collect()}
    assert set(got) == {1, 2, 3} and max(r["distance"] for r in got.values()) <= 2**63 - 1


@pytest.mark.parametrize("seed", range(5))
def test_screening_never_loses_the_nearest(seed):
    rng = np.random.default_rng(seed)
    whole = rng.integers(-50, 50, (500, 64)) + 40 * rng.integers(-3, 3, (500, 1))
    c = whole[rng.integers(0, 500, 16)] + rng.integers(-1, 2, (16, 64))
    brief = centroids.short(whole).astype(np.float32).astype(float)
    best, distance, exact = centroids.nearest(whole, brief, c, centroids.short(c))
    all_ = ((whole[:, None] - c[None]) ** 2).sum(2)
    assert (best == all_.argmin(1)).all() and (distance == all_.min(1)).all()
    assert exact < all_.size / 2  # most were screened


# ---- alignment -------------------------------------------------------------


def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    bytes_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for i, t in rows:
        own = (i, [], [], [], [])
        if t:
            whole = (" " + t).encode()
            e = a.encode(" " + t, add_special_tokens=False)
            ids_a, ids_b = e.ids, b.encode(t)
            ends_a = np.cumsum([len(align.byte_level(x)) for x in e.tokens]).tolist()
            ends_b = np.cumsum([len(bytes_b(x)) for x in ids_b]).tolist()
            if b"".join(map(bytes_b, ids_b)) == whole and b"".join(map(align.byte_level, e.tokens)) == whole:
                links = [(x, y) for x, s, u in zip(ids_a, [0, *ends_a], ends_a) for y, v, w in zip(ids_b, [0, *ends_b], ends_b) if s < w and v < u]
                groups, ga, gb = [], 0, 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    na, nb = ends_a.index(end) + 1, ends_b.index(end) + 1
                    groups.append(",".join(map(str, ids_a[ga:na])) + "|" + ",".join(map(str, ids_b[gb:nb])))
                    ga, gb = na, nb
                own = (i, ids_a, ids_b, groups, links)
        found.append(own)
    count = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return Counter((i, len(x), len(y), len(g), len(k), sum(count[p] == most[p[0]] for p in k), sum(count[p] for p in k), sha(";".join(g)) if x else "") for i, x, y, g, k in found)


TEXTS = ["Hello world", "The internationalisation of tokenisers, e.g. 'don't' and 1234567.", "  two  spaces   three ", "\n\nlines\n with\ttabs \n", "naïve café   déjà-vu", "日本語のテキスト と 漢字", "emoji \U0001f600\U0001f468‍\U0001f469 ok", "a▁b", "<|endoftext|> in a <s>text</s> <0x41>", "x" * 500, " ", "\t", "…—‘quoted’ ", "𝔘𝔫𝔦", "\x00\x01 control", "ﬁ ligature Å Å", "end with space ", "Hello world"]


def test_alignment(spark):
    rng = random.Random(8)
    letters = "abcdefghij ÄßéñЖ日\U0001f600 \n\t.,'<>|▁0123456789 "
    rows = list(enumerate(TEXTS)) + [(100 + i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 80)))) for i in range(150)]
    rows += [(None, "Hello world"), (None, None), (3, "Hello world"), (900, None), (901, "")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = plain_alignment(rows)
    assert Counter(map(tuple, align.align(df).collect())) == want
    assert Counter(map(tuple, align.align(df, frequent=20).collect())) == want  # nearly all pairs through the join


def test_alignment_of_a_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(60).collect()]
    rows.append((10**9, " ".join(t or "" for _, t in rows[:5]) * 3))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, align.align(df).collect())) == plain_alignment(rows)
    assert align.align(df.limit(0)).collect() == []


def test_transducer_forgets_and_refuses():
    t = align.Transducer({1: b" ab", 2: b"c"}, {1: b" a", 2: b"bc", 3: b"x"}, most=1)
    for _ in range(3):
        states = t.run([1, 2, 1, 2], [1, 2, 1, 2])
        a, b, x, y = align.read_out(states, np.array([1, 2, 1, 2]), np.array([1, 2, 1, 2]))
        assert a.tolist() == [2, 4] and b.tolist() == [2, 4]
        assert list(zip(x.tolist(), y.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (2, 3), (3, 3)]
    assert t.run([1, 2], [1, 3]) is None and t.run([1, 2], [1]) is None and t.run([1], [1, 2]) is None
    assert t.run([], []).tolist() == []


def test_forgetful_aligner(monkeypatch):
    import public_tokenizers as P
    import pyarrow as pa

    a, b = align.default_tokenizers()
    assert a == P.path("byte_bpe_50k.json")
    keen = align.Aligner(a, b).of(pa.array(TEXTS))
    monkeypatch.setattr(align, "REMEMBERED", 0)
    monkeypatch.setattr(align, "STEPS", 3)
    poor = align.Aligner(a, b)
    for i, t in enumerate(TEXTS):
        assert poor.of(pa.array([t])).to_pylist() == keen.slice(i, 1).to_pylist()
