"""The operators against brute force on a small table with every odd case."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import exact_dedup, flow, html_render, jaccard, langid, mixing, packing, reshard, substring, toxicity, vectors
from ledgerloom.llm.components import components


def by_sql(rows, name):
    """A query's SQL in DuckDB over the small table: {doc_id: the other columns}."""
    import duckdb
    import pandas as pd

    from ledgerloom.llm.sql import ORACLES

    documents = pd.DataFrame({"doc_id": [r[0] for r in rows], "text": pd.Series([r[1] for r in rows], dtype=object)})  # noqa: F841
    return {r[0]: tuple(r[1:]) for r in duckdb.sql(ORACLES[name]).fetchall()}


def kept_words(rows):
    """{doc_id: (words, words removed, digest of the rest)} by comparing all windows."""
    first, want = {}, {}
    for i, t, *_ in sorted(rows):
        w = (t or "").encode().split()
        keep, own = [True] * len(w), set()
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            if k in first:
                keep[j : j + 50] = [False] * 50
            own.add(k)
        for k in own:
            first.setdefault(k, i)
        want[i] = (len(w), keep.count(False), hashlib.sha256(b" ".join(x for x, y in zip(w, keep) if y)).hexdigest())
    return want


def test_substring(docs, rows, none):
    want = kept_words(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(docs).collect()}
    assert got == want == by_sql(rows, "op1_substring_dedup") and sum(v[1] for v in want.values()) > 500
    assert substring.substring_dedup(none).count() == 0


def crossing(seed):
    """Texts woven from long passages that branch, meet again, run in rings and differ by single words."""
    rng = random.Random(seed)
    some = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    parts, ring = [some(rng.choice((20, 45, 60, 90))) for _ in range(6)], some(30)
    texts = [" ".join(w for p in rng.choices(parts, k=rng.randint(1, 5)) for w in p) for _ in range(40)]
    texts += [" ".join(ring * k) for k in (2, 3, 5)] + [" ".join(ring[7:] + ring * 3), "again " * 90, "again " * 60]
    for t in texts[:15]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, bits", [(1, 64), (2, 64), (3, 64), (4, 3), (5, 6)])
def test_substring_where_paths_branch(spark, seed, bits):
    """Against brute force; with few bits of hash, most claims are false and must be mended."""
    rows = crossing(seed)
    out = substring.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=bits).collect()
    want = kept_words(rows)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == want and sum(v[1] for v in want.values()) > 2000


def test_paths_compact(spark):
    """A chain whose edges have sources in several places is one path; a ring of pieces stays apart."""
    chain = [(n, n + 1, 1, n % 3, n) for n in range(20)]
    ring = [(100, 101, 1, 7, 0), (101, 102, 1, 8, 0), (102, 100, 1, 9, 0)]
    fork = [(20, 200, 1, 4, 0), (20, 201, 1, 5, 0)]
    edges = spark.createDataFrame(chain + ring + fork, "u long, v long, doc_id long, walk long, i int")
    got = {(r.u, r.v): (tuple(r.path), r.place) for r in substring._compacted(edges).collect()}
    assert len(got) == 25 and len(set(got.values())) == 25
    assert [got[n, n + 1] for n in range(20)] == [((0, 0), n) for n in range(20)]
    assert {got[20, 200][1], got[20, 201][1]} == {0}


def test_exact(docs, rows, none):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows}
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == want == by_sql(rows, "op2_exact_dedup")
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = {r.doc_id for r in exact_dedup.without_copies(docs).collect()}
    assert kept == {i for i, w in want.items() if w[2]}
    # A frequent digest and a split with few counters give the same.
    few = exact_dedup.exact_dedup(docs, max_heavy=2, counters=16)
    assert {r.doc_id: r.keep_id for r in few.collect()} == {i: w[0] for i, w in want.items()}


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(docs, rows, none):
    sets = {i: shingles(t) for i, t, *_ in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            comp[max(x, y)] = min(x, y)
    want = {i: (len(s), find(i)) for i, s in sets.items()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(docs).collect()}
    assert got == want == by_sql(rows, "op5_ngram_jaccard_join") and sum(find(i) != i for i in sets) > 15
    assert jaccard.jaccard_groups(none).count() == 0


def shares_as_needed(a, b, low):
    return any(len(np.intersect1d(ka, kb)) >= max(na, nb, 1) for (ka, na), (kb, nb) in zip(jaccard.band_keys(a, low), jaccard.band_keys(b, low)))


@pytest.mark.parametrize("n", [4, 5, 7, 8, 9, 12, 15, 16, 17, 20, 31, 33, 40, 64, 80, 200])
def test_similar_sets_share_a_key(n):
    """The pigeonhole: sets at a Jaccard of 0.8 or more share as many keys as each of them needs."""
    rng = np.random.default_rng(n)
    for _ in range(60):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        cut, more = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
        b = np.concatenate([a[cut:], rng.integers(0, 2**63, more, dtype=np.uint64)])
        if not jaccard.similar(np.sort(a), np.sort(b)) or (cut == more == 0):
            continue
        low = set(jaccard.bands(len(a))) & set(jaccard.bands(len(b)))
        assert low
        assert any(shares_as_needed(np.sort(a), np.sort(b), x) for x in low)


@pytest.mark.parametrize("low", [8, 16, 32, 64, 128])
def test_sets_across_a_band_limit_share_as_many_keys_as_they_need(low):
    """The worst case: every difference lies in a segment of its own."""
    rng = np.random.default_rng(low)
    top = 2 * low - 1
    m = (top // 4 + 2) // 2 if low < jaccard.SMALL else 3 * top // 8 + 1
    some = np.unique(rng.integers(0, 2**63, 40 * top, dtype=np.uint64))
    seg = (jaccard.mix(some + np.uint64(low * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(m)).astype(int)
    pool = [list(some[seg == j]) for j in range(m)]
    deal = lambda n: [pool[j % m].pop() for j in range(n)]
    tried = 0
    for a in range(low, top + 1):
        for b in range(top + 1, a * 5 // 4 + 1):
            for lost in range(a // 9 + 1):
                if 5 * (a - lost) < 4 * (b + lost):
                    continue
                kept = pool
                pool = [list(x) for x in kept]
                both, apart = deal(a - lost), deal(b - a + 2 * lost)
                pool = kept
                x, y = (np.sort(np.array(both + part, np.uint64)) for part in (apart[:lost], apart[lost:]))
                assert jaccard.similar(x, y) and (len(x), len(y)) == (a, b) and low in jaccard.bands(a) and low in jaccard.bands(b)
                assert shares_as_needed(x, y, low), (a, b, lost)
                tried += 1
    assert tried


def test_blockwise_finds_what_a_star_leaves(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for k in range(40):  # copies that drift along a chain
        base[rng.randrange(100)] = f"v{k}"
        texts.append(" ".join(base))
    rows = [(i, t) for i, t in enumerate(texts)]
    sets = [shingles(t) for t in texts]
    comp = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = comp[a], comp[b]
            comp = [min(x, y) if c in (x, y) else c for c in comp]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(comp))


def test_uneven_sets_share_no_empty_segment():
    """No key stands for an empty segment, and sets with few filled segments still meet."""
    rng, seen = np.random.default_rng(1), Counter()
    for n in range(4, 40):
        for low in jaccard.bands(n):
            for _ in range(300):
                a = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
                groups = jaccard.band_keys(a, low)
                assert all(0 < need <= len(k) for k, need in groups)
                seen.update({k for g, _ in groups for k in g.tolist()})
                b = np.sort(np.concatenate((a[1:], rng.integers(0, 2**63, 1, dtype=np.uint64))))
                if jaccard.similar(a, b):
                    assert shares_as_needed(a, b, low)
    assert max(seen.values()) == 1


def test_boilerplate_is_no_family(spark):
    """5000 documents with one long passage in common and no two alike, and a pair among them."""
    rng = random.Random(6)
    some = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    common = some(60)
    rows = [(i, common + " " + some(60)) for i in range(5000)]
    rows.append((9000, rows[77][1] + " end"))
    got = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("doc_id <> component_id").collect()
    assert [(r.doc_id, r.component_id) for r in got] == [(9000, 77)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 50: 50, 70: 50, 100: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_flow_is_cheapest():
    net = flow.MinCostFlow(4)
    a, b = net.add(0, 1, 5, 1), net.add(0, 2, 5, 0)
    net.add(1, 3, 4, 0), net.add(2, 3, 3, 0), net.add(2, 1, 9, 0)
    assert net.solve(0, 3) == (7, 2) and (net.flow(a), net.flow(b)) == (2, 5)


def test_mixing(spark, docs, rows, none):
    size = {i: len((t or "").encode().split()) for i, t, *_ in rows}
    out = mixing.source_mix(docs).collect()
    assert len(out) == len(rows) and all(r.size == size[r.doc_id] and r.taken in [k * r.size for k in range(4)] for r in out)
    total, by, target = sum(size.values()), Counter(), {}
    for r in out:
        by[r.source] += r.taken
        target[r.source] = r.target
    assert abs(sum(target.values()) - total) < 1e-6
    assert all(abs(by[s] - target[s]) <= 0.08 * target[s] for s in target), [(s, by[s], target[s]) for s in target]
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(out) == order(mixing.source_mix(docs.repartition(5)).collect())
    assert mixing.source_mix(none).count() == 0
    assert mixing.targets_of({"a": 10, "b": 100, None: 1000}) == {"a": 30.0, "b": 300.0, None: 780.0}
    overlapping = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 15, "b": 15})
    assert overlapping == {("a",): 10, ("a", "b"): 10, ("b",): 10}
    same = spark.createDataFrame([(None, "w " * 10, "a")] * 50 + [(None, "v " * 10, "a")] * 20 + [(i, "w " * 10, "b") for i in range(9)], "doc_id long, text string, source string")
    of = Counter()
    for r in (got := mixing.source_mix(same).collect()):
        of[r.source] += r.taken
    assert all(abs(of[r.source] - r.target) <= 10 for r in got)
    copies = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert copies == Counter({r.doc_id: r.copies for r in out if r.copies})


def test_resharding(spark, docs, rows, none, tmp_path):
    out = reshard.reshard(docs).collect()
    text = {i: t or "" for i, t, *_ in rows}
    assert len(out) == len(rows)
    slots = defaultdict(list)
    for r in out:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id].encode()) + 1, zlib.crc32(text[r.doc_id].encode()), "bytes", None)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert reshard.reshard(none).count() == 0
    moves = reshard.plan_moves({0: 100, 1: 20}, [(0, f"b{k}", 10) for k in range(10)] + [(1, f"c{k}", 10) for k in range(2)], 3)
    load = Counter(moves.values())
    assert load == {0: 4, 1: 4, 2: 4} and all(v == 1 for (o, _), v in moves.items() if o == 1) and sum(v == 0 for (o, _), v in moves.items() if o == 0) == 4
    rng = random.Random(8)
    for _ in range(12):  # against all plans that are as even
        blocks = [(rng.randrange(2), f"b{k}", rng.randint(1, 9)) for k in range(7)]
        sizes = {o: sum(b[2] for b in blocks if b[0] == o) for o in {b[0] for b in blocks}}
        moves = reshard.plan_moves(sizes, blocks, 3)
        cost = lambda to: sum(b[2] for b, k in zip(blocks, to) if b[0] != k)
        spread = lambda to: max(x := [sum(b[2] for b, k in zip(blocks, to) if k == j) for j in range(3)]) - min(x)
        own = [moves[b[0], b[1]] for b in blocks]
        best = min(cost(to) for to in product(range(3), repeat=7) if spread(to) <= spread(own))
        assert cost(own) <= best + max(b[2] for b in blocks)
    small = spark.createDataFrame([(i, f"text {i}" * (1 + i % 9)) for i in range(400)], "doc_id long, text string")
    plan = reshard.reshard(small, n_old=3, n_new=4)
    path = str(tmp_path / "t")
    small.join(plan.select("doc_id", plan.old_shard.alias("shard"), "slot"), "doc_id").write.partitionBy("shard").parquet(path)
    stored = spark.read.parquet(path)
    again = reshard.reshard(stored.select("doc_id", "text", "shard"), n_new=4, old_shard="shard").cache()
    reshard.rewrite(stored, again, path)
    after = {(r.doc_id, r.shard) for r in spark.read.parquet(path).collect()}
    assert after == {(r.doc_id, r.shard) for r in again.collect()} and len(after) == 400
    load = Counter()
    for r in again.collect():
        load[r.shard] += r.size
    assert max(load.values()) < 1.1 * min(load.values())


def test_packing(spark, docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {i: x or "" for i, x, *_ in rows}
    ids = {i: np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for i, x in text.items()}
    out = packing.pack(docs, keep_ids=True).collect()
    back, places = defaultdict(dict), defaultdict(list)
    for r in out:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(piece.tobytes()), bytes(r.ids), r.doc_tokens) == (r.length, r.ids_crc32, piece.tobytes(), len(ids[r.doc_id]))
        back[r.doc_id][r.start] = r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert {i: sum(v.values()) for i, v in back.items()} == {i: len(v) for i, v in ids.items()}
    for v in places.values():
        v.sort()
        assert [a for a, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and v[-1][0] + v[-1][1] <= 2048
    assert packing.pack(none).count() == 0


def test_ids_are_those_of_the_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, encode = Tokenizer.from_file(path), packing.Ids(path)
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\u3000", "\xa0", "\u0085", "\x1c", "é", "中", "\u2014", "'s", "1", "!", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["a  b", " lead", "trail ", "a\n\n b \t c", "a <|endoftext|> b", "it's 12345 éè́ \U0001f600\u200d", "x" * 5000, "　  a", "", None]
    for _ in range(2):  # again, from what is remembered
        for x, ids in zip(texts, encode.of(pa.array(texts, pa.string()))):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids
    odd = [b"ok \xff\xfe then", b"\xc3 (", b" \xe4\xb8 a b"]
    assert [bytes(i) for i in encode.of(pa.array(odd))] == encode._encode(odd)


def test_bins_are_filled():
    rng = random.Random(3)
    counts = Counter(rng.randint(1, 2047) for _ in range(3000))
    patterns = packing.fill(counts)
    used = Counter()
    for times, u in patterns:
        assert sum(n * k for n, k in u.items()) <= 2048
        for n, k in u.items():
            used[n] += times * k
    bins = sum(t for t, _ in patterns)
    assert used == counts and bins <= 1.02 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_language(spark, none):
    import zlib as z

    rng = random.Random(4)
    letters = {"aa": "abcdefg ", "bb": "mnopqrs ", "cc": "aeioutvz "}
    rows = [(i, "".join(rng.choice(letters[k]) for _ in range(rng.randint(40, 400))), k) for i, k in enumerate(sorted(letters) * 60)]
    df = spark.createDataFrame([*rows, (1000, None, "aa"), (1001, "", None), (1002, "12 34 !", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(df.where(langid.fold("doc_id", 4) != 2))
    got = {r.doc_id: r for r in langid.identify(df, model, "lang").collect()}
    held = [(i, k) for i, _, k in rows if z.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == k for i, k in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [(got[i].lang_pred, got[i].score, got[i].rejected) for i in (1000, 1001, 1002)] == [("und", 0.0, True)] * 3
    kept = {r.doc_id for r in langid.accepted(df, model).collect()}
    assert {i for i, *_ in rows} <= kept and not kept & {1000, 1001, 1002}
    assert langid.fit(none).langs == [] and langid.identify(none, model).count() == 0
    signs = spark.createDataFrame([(1, "½ ² Ⅷ 12"), (2, "\u0301 \u0300")], "doc_id long, text string")
    assert {r.lang_pred for r in langid.identify(signs, model).collect()} == {"und"}
    assert (langid.gram_counts("हिन्दी") == langid.gram_counts("हिन्दी!")).all() and langid._GAPS.sub(" ", "हिन्दी") == "हिन्दी"
    alien = spark.createDataFrame([(1, "你好世界" * 30)], "doc_id long, text string")
    assert langid.identify(alien, model).first().rejected


def test_long_texts_are_counted_whole(monkeypatch):
    rng = random.Random(5)
    text = "".join(rng.choice("abcdé  ,.1") for _ in range(5000))
    whole = langid.gram_counts(text)
    for part in (1, 7, 500, 4999, 5000):
        monkeypatch.setattr(langid, "_PART", part)
        assert (langid.gram_counts(text) == whole).all()


def test_toxicity(spark):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    rows = []
    for i in range(400):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["zonker", "Zonkers", "z0nker", "zоnker"])
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    lexicon = toxicity.fit(df.where("doc_id % 5 <> 0"), exceptions=("zonker pie",))
    got = {r.doc_id: r.score for r in toxicity.score(df, lexicon).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a zonker pie"), (4, "a Z0NKER!"), (5, "zonker pie and zonker")], "doc_id long, text string")
    s = {r.doc_id: (r.weight, r.score) for r in toxicity.score(odd, lexicon).collect()}
    assert s[1][0] == s[2][0] == s[3][0] == 0 and s[4][1] >= 0.5 and s[5][0] > 0
    empty = toxicity.fit(df.limit(0))
    assert empty.weights == {} and toxicity.score(df.limit(0), empty).count() == 0
    assert set(lexicon.weights) == {"zonker"}  # no noise
    # A phrase of harmless rows alone becomes an exception; the word outside it still counts.
    more = rows + [(1000 + i, f"{plain[i % 80]} zonker pie {plain[i % 7]}", 0) for i in range(6)]
    learned = toxicity.fit(spark.createDataFrame(more, "doc_id long, text string, label int"))
    assert "zonker pie" in learned.exceptions
    s = {r.doc_id: r.weight for r in toxicity.score(odd, learned).collect()}
    assert s[3] == 0 and s[4] > 0 and s[5] > 0


def test_long_texts_are_weighed_in_linear_time():
    lexicon = toxicity.Lexicon({"zonker": 2.0}, ("zonker pie",))
    made, took = lexicon.automaton(), []
    for n in (4000, 16000):
        t = time.process_time()
        assert lexicon.weigh(made, "zonker pie -- zonker!\n" * n) == (2.0 * n, 3 * n)
        took.append(time.process_time() - t)
    assert took[1] < 10 * max(took[0], 0.02)


def test_html():
    r = html_render.render
    assert r(None) == r("") == r("<script>x</script><p hidden>y</p><p style='display:none'>z</p>") == ""
    assert r("<p>a <b>b</b>\n c<p>d<br>e") == "a b c\n\nd\ne"
    assert r("<ul><li>x<li>y<ol><li>p<li>q</ol></ul>") == "- x\n- y\n  1. p\n  2. q"
    assert r("<table><tr><td>a<td>long<tr><th>bbb<td>c</table>") == "a    long\nbbb  c"
    assert r("<pre>\n x\n  y</pre>z &amp; &lt;w&gt;") == " x\n  y\n\nz & <w>".strip("\n")
    assert r("<div>a</div><div>b<table><tr><td colspan=2>wide cell<tr><td>1<td>2</table>c</div>") == "a\nb\n\nwide cell\n1  2\n\nc"
    assert r("<div>" * 5000 + "deep") == "deep"
    assert r("<table><tr><td>" * 200 + "deep").strip() == "deep"
    assert r("a < b and <unclosed 'x") == "a < b and <unclosed 'x"


def test_spans_and_visibility():
    r = html_render.render
    assert r("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>") == "A  b\n   c"
    assert r("<table><tr><td colspan=2>very wide header<td>Z<tr><td>1<td>2<td>z</table>") == "very wide header  Z\n1  2              z"
    assert r("<table><tr><td>日本<td>b<tr><td>abcde<td>c</table>") == "日本   b\nabcde  c"
    assert r("<table><tr><td rowspan=0 colspan=1000>x<td>y<tr><td>z</table>").split() == ["x", "y", "z"]
    assert r("<div style='visibility:hidden'>no<b style='visibility: visible'>yes</b>no</div>") == "yes"
    assert r("<style>.x{display:none} @media print{p{display:none}} #k, b.y {visibility:hidden}</style><p class='a x'>no<p>yes <b class=y>no</b><i id=k>no</i>") == "yes"
    assert r("<svg><title>t</title><path d='x'/><text>label</text></svg> and <math><mi>x</mi><mo>=</mo></math>") == "label and x="
    assert r("<p>a <a href='x>b</a> c") == "a b c"


def test_nested_tables_are_whole():
    depth = 400
    text = html_render.render("<table><tr><td>x" * depth + "</table>" * depth)
    assert text.split() == ["x"] * depth


@pytest.mark.parametrize("bad", ["<a ", '<a b="', "<a b='x' ", "<", "<!--", "</", "<div></p></x>", "<table><td>", "<p><b>", "&lt;<![CDATA["])
def test_bad_pages_take_linear_time(bad):
    took = []
    for n in (3000, 12000):
        t = time.process_time()
        html_render.tree(bad * n)
        took.append(time.process_time() - t)
    assert took[1] < 12 * max(took[0], 0.02)


def test_pages(spark):
    df = spark.createDataFrame([(1, "<p>x"), (2, None), (None, "<p>y"), (1, "<p>x")], "page_id long, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_render.render_pages(df).collect()) == [(0, "y"), (1, "x"), (1, "x"), (2, "")]
    assert html_render.render_pages(df.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(120, 16))
    rows = [v for v in base] + [base[i] + rng.normal(size=16) * 0.08 for i in range(60) for _ in range(2)] + [base[0]] * 30 + [2 * base[1]]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0, 3.0]]
    short = [[1.0, 1.0], [2.0, 2.0], [1.0, 1.01], [-1.0, 1.0]]  # another length links among itself
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(1000 + i, v) for i, v in enumerate(odd)] + [(2000 + i, v) for i, v in enumerate(short)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(3)
    v = np.array(rows)
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(v))
    for _ in range(len(v)):
        for a, b in np.argwhere(near):
            comp[a] = comp[b] = min(comp[a], comp[b])
        if all(comp[a] == comp[b] for a, b in np.argwhere(near)):
            break
    out, recall = vectors.link_vectors(df)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out.collect()}
    assert recall >= 0.97
    assert {i: got[i] for i in range(len(v))} == {i: (int(near[i].sum()), int(comp[i]), bool(comp[i] == i)) for i in range(len(v))}
    assert all(got[1000 + i] == (0, 1000 + i, True) for i in range(len(odd)))
    assert [got[2000 + i] for i in range(4)] == [(2, 2000, True), (2, 2000, False), (2, 2000, False), (0, 2003, True)]
    assert vectors.link_vectors(df.limit(0))[0].count() == 0


def test_shards_are_split_until_they_fit(spark, monkeypatch):
    """Small caps: several rounds of splitting, dense groups over the cap with core and other members, edges across shards."""
    monkeypatch.setattr(vectors, "CAP", 40)
    monkeypatch.setattr(vectors, "SPLIT", 4)
    monkeypatch.setattr(vectors, "CHUNK", 150)
    monkeypatch.setattr(vectors, "MOST", vectors.OVERLAP)
    monkeypatch.setattr(vectors, "_exact_links", None)  # not needed
    rng = np.random.default_rng(12)
    v = rng.normal(size=(700, 24))
    v[:150] = v[0] + rng.normal(size=(150, 24)) * 0.05  # a dense core
    v[150:230] = v[150] + rng.normal(size=(80, 24)) * 0.22  # wider than the core
    v[600:] = v[400:500] + rng.normal(size=(100, 24)) * 0.1
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    out, recall = vectors.link_vectors(df)
    got = {r.vec_id: r.n_links for r in out.collect()}
    true = near.sum(1)
    assert recall >= vectors.RECALL and all(got[i] <= true[i] for i in got)
    assert sum(got.values()) >= 0.97 * true.sum() and sum(got[i] == true[i] for i in got) >= 0.97 * len(v)


def test_graph_search_alone():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 24))
    v[:200] = v[0] + rng.normal(size=(200, 24)) * 0.15
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    lists = vectors.robust_prune(v)
    graph = np.array([list(g) + [-1] * (max(map(len, lists)) - len(g)) for g in lists])
    found = vectors.range_search(v, graph, v[::9], vectors.medoid(v))
    want = v[::9] @ v.T >= 0.95
    assert not (found & ~want).any() and found.sum() >= 0.95 * want.sum()


def test_a_dense_group_is_not_cut_up():
    """Many centroids fall into one group of distinct near copies; its pairs still share a shard."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 64))
    v[:1000] = v[0] + rng.normal(size=(1000, 64)) * 0.2 * np.linalg.norm(v[0]) / 8
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = vectors._centroids(v, 400)
    shards = np.argsort(-(v @ c.T), axis=1)[:, : vectors.OVERLAP]
    met = sum((shards[:1000, None, x] == shards[None, :1000, y]) for x in range(vectors.OVERLAP) for y in range(vectors.OVERLAP)) > 0
    near = v[:1000] @ v[:1000].T >= 0.95
    np.fill_diagonal(near, False)
    assert near.sum() > 100_000 and (met & near).sum() >= 0.97 * near.sum()
    assert len(c) > 200  # ordinary rows keep theirs


def test_links_are_whole_where_the_graph_falls_short(spark, monkeypatch):
    rng = np.random.default_rng(10)
    v = rng.normal(size=(150, 16))
    v[50:90] = v[0] + rng.normal(size=(40, 16)) * 0.12
    v[100:] = v[:50] + rng.normal(size=(50, 16)) * 0.05
    v = np.concatenate((v, v[:3]))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    comp = np.arange(len(v))
    while (low := np.minimum(comp, np.where(near, comp, len(v)).min(1))).tolist() != comp.tolist():
        comp = low
    nothing = spark.createDataFrame([], "node long, links long"), spark.createDataFrame([], "node long, component long")
    monkeypatch.setattr(vectors, "_graph_links", lambda *_: nothing)
    monkeypatch.setattr(vectors, "QUERIES", 40)
    out, recall = vectors.link_vectors(df)
    assert recall >= vectors.RECALL
    assert {r.vec_id: (r.n_links, r.component_id) for r in out.collect()} == {i: (int(near[i].sum()), int(comp[i])) for i in range(len(v))}


def test_audit_sees_lost_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(400, 32))
    v[:200] = v[0] + rng.normal(size=(200, 32)) * 0.02
    v[300:] = v[200:300] + rng.normal(size=(100, 32)) * 0.02
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, i, [float(x) for x in r], 1) for i, r in enumerate(v)], "node long, first long, unit array<double>, copies long")
    links = ((v @ v.T >= 0.95).sum(1) - 1).tolist()
    whole = spark.createDataFrame(list(enumerate(links)), "node long, links long")
    assert vectors._audit(nodes, whole, 0.95) == 1
    for lost in (whole.where("node < 200 or node % 4 <> 0"), whole.where("node < 200").unionAll(whole.where("node >= 200").selectExpr("node", "if(node % 4 = 0, 0, links)"))):
        assert vectors._audit(nodes, lost, 0.95) < vectors.RECALL
