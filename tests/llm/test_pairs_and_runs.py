"""Similarity sketches, hard negatives and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import jaccard, minhash, negatives, periodic, queries

DATA = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, n_words string, runs int, collapsed int, words string, g string, a int, p int, tile int, key int, n int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 1, "x", "x", 1, 1, 1, 1, 1) for i, t in rows], CLASH)


# Sketches


def test_sketches_fill_every_coordinate_and_are_concentrated():
    rng = np.random.default_rng(1)
    sizes = [1, 2, 7, 60, 199, 1000, 20_000]
    sets = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in sizes]
    out = minhash.sketches(sets)
    assert out.shape == (len(sizes), minhash.COORDINATES) and (out != 0).all()
    for one, row in zip(sets, out):  # a sketch is of its own set alone
        assert (minhash.sketches([one])[0] == row).all()
    off = []
    for n in (50, 400, 3000):
        for share in (0.5, 0.8, 0.95):
            for _ in range(20):
                same = round(2 * n * share / (1 + share))
                x = rng.integers(0, 2**63, 2 * n - same, np.uint64)
                a, b = minhash.sketches([np.sort(x[:n]), np.sort(x[n - same :])])
                off.append((a == b).mean() - same / (2 * n - same))
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.16


@pytest.mark.parametrize("n", [5, 30, 200, 2000])
def test_bands_find_all_pairs_at_the_threshold(n):
    rng = np.random.default_rng(n)
    missed = 0
    for _ in range(150):
        same = -(-2 * n * 80 // 180)  # the least overlap of linked sets
        x = rng.integers(0, 2**63, 2 * n - same, np.uint64)
        one, two = minhash.bands(minhash.sketches([np.sort(x[:n]), np.sort(x[n - same :])]))
        missed += not (one == two).any()
    assert not missed


def brute_components(rows, width, share):
    def grams(text):
        w = WORDS.findall((text or "").translate(LOWER))
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k)), least.get(find(k)) == i) for k, (i, _) in enumerate(rows))


def copies(seed=4, n=70):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "日本", "The", "the"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 25, 80, 200]))] for _ in range(9)]
    common = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i * 2 + 1, rng.choice([" ", "\n", " \t"]).join(words + common * (i % 3 == 0))))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (None, "one"), (None, "alone here"), (905, "w1 " * 20_000), (905, "w1 " * 20_000)]


def test_near_duplicates(spark):
    rows = copies()
    got = minhash.near_duplicates(frame(spark, rows), width=4, share=80)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(map(tuple, got.collect())) == brute_components(rows, 4, 80)
    assert minhash.near_duplicates(frame(spark, []), width=4).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(frame(spark, rows), share=79)


def test_hot_bands_lose_no_link(spark, monkeypatch):
    """All sets share one tile, whatever they hold, so that every step of a hot tile decides some of them."""
    for name, value in (("FEW", 2), ("BLOCK", 8), ("HOT", 4), ("ROUNDS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(minhash, "by_bands", lambda docs, width, share: (jaccard.describe(docs, width, lambda sets: [np.array([7], np.uint64) for _ in sets]), None))
    rows = copies(n=50)
    assert Counter(map(tuple, minhash.near_duplicates(frame(spark, rows), width=4, share=80).collect())) == brute_components(rows, 4, 80)


@pytest.mark.parametrize("pairs", [64, 0])
def test_hot_bands_of_nearly_linked_sets_are_not_multiplied(spark, monkeypatch, pairs):
    """Most n-grams are in most sets of a tile, so that each part of it would be as hot as the tile, and be divided again."""
    for name, value in (("FEW", 2), ("BLOCK", 8), ("HOT", 4), ("ROUNDS", 1), ("PAIRS", pairs)):  # 0: all hot tiles are divided once
        monkeypatch.setattr(jaccard, name, value, raising=False)
    monkeypatch.setattr(minhash, "by_bands", lambda docs, width, share: (jaccard.describe(docs, width, lambda sets: [np.array([7], np.uint64) for _ in sets]), None))
    rng = random.Random(8)
    root = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(f"x{i}" if j in edits else w for j, w in enumerate(root))) for i in range(30) for edits in [rng.sample(range(60), 2 if i % 5 else 1)]]
    told = []
    monkeypatch.setattr(jaccard, "stash", lambda df, tag, f=jaccard.stash: (out := f(df, tag), told.append((tag, out.count())))[0])
    assert Counter(map(tuple, minhash.near_duplicates(frame(spark, rows), width=4, share=80).collect())) == brute_components(rows, 4, 80)
    assert sum(n for tag, n in told if tag == "undecided") <= (0 if pairs else 30 * 13)


def test_packed_counts():
    counts = np.zeros(jaccard.PART, np.int64)
    counts[[0, 5, 9, 65_535]] = 1, 300, 2**40, 7
    assert (jaccard.unpacked(jaccard.packed(counts)) == counts).all()


# Hard negatives


def brute_negatives(rows, every, positives, count, low, high, scale):
    fine = [(i, lab, tuple(math.floor(scale * float(x)) for x in v)) for i, v, lab in rows if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, lab, v in {x for x in fine if x[0] is not None and x[0] % every == 0}:
        scored = sorted(((sum(p * q for p, q in zip(v, w)), i, other) for i, other, w in fine if i != a and len(w) == len(v)), key=lambda x: (-x[0], last(x[1])))
        for score, i, _ in [x for x in scored if x[2] == lab][:positives]:
            some = [x for x in scored if x[2] != lab and low * score <= 100 * x[0] <= high * score][:count]
            out += [(a, i, k + 1, other, score, s) for k, (s, other, _) in enumerate(some)]
    return Counter(out)


SCHEMA = "vec_id long, embedding array<float>, label int, slot string, score string, rank string, part int"


@pytest.mark.parametrize("block_bytes", [16 << 20, 600])
def test_hard_negatives(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(negatives, "PRODUCTS", 50)
    rng = random.Random(2)
    vector = lambda n: [rng.choice([-0.5, -0.1, 0.0, 0.013, 0.2, 0.5, 1.0]) for _ in range(n)]
    rows = [(i, vector(4), rng.randrange(3)) for i in range(120)]
    rows += [(None, vector(4), 1), (200, vector(4), None), (201, None, 1), (202, [0.1, None, 0.2, 0.1], 1), (203, [0.1, float("nan"), 0.2, 0.1], 1), (204, [0.1, float("inf"), 0.2, 0.1], 1)]
    rows += [(300, [], 0), (301, [], 0), (302, [], 1), (310, vector(3), 1), (311, vector(3), 1), (312, vector(3), 2)]
    rows += [(320, [1.0, 1.0, 1.0, 1.0], 2)] * 2 + [(400 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(60)] + [(330, vector(4), 0), (330, vector(4), 1)]
    df = spark.createDataFrame([(*r, "x", "x", "x", 1) for r in rows], SCHEMA).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, positives=3, negatives=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10, 3, 4, 30, 90, 256)
    assert len(want) > 50 and Counter(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(df, F.lit(False)).count() == 0
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0


def test_products_that_are_not_exact_are_an_error():
    with pytest.raises(ValueError, match="exact"):
        negatives.products(np.full((1, 4), 2.0**26), np.full((1, 4), 2.0**26))


# Periodic runs


def brute_runs(words, shortest=24):
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            a = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - a + p >= max(shortest, 3 * p):
                found.setdefault((a, i - a + p), p)  # periods ascend
    return sorted((a, size, p) for (a, size), p in found.items())


def collapsed(words, found):
    gone = {k for a, size, p in found for k in range(a + p, a + size)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abC"), max_size=40), st.integers(1, 5), st.lists(st.sampled_from("ab"), max_size=6)), min_size=1, max_size=5), st.sampled_from([3, 8, 24]))
def test_runs(parts, shortest):
    docs = [unit[:9] * times + rest + unit for unit, times, rest in parts]
    n, at, found, texts = periodic.described(pa.array(["\n".join(w) for w in docs]), shortest)
    for k, words in enumerate(docs):
        want = brute_runs(words, shortest)
        assert list(zip(*(x[at[k] : at[k + 1]].tolist() for x in found))) == want
        assert n[k] == len(words) and texts[k].as_py() == collapsed(words, want)


def test_runs_of_long_texts():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 4000, 30_000)
    period = 7001
    i = np.arange(2_000, 28_000)
    words[i] = words[2_000 + (i - 2_000) % period]
    words[[1_999, 28_000]] = -1, -2
    _, at, found, _ = periodic.described(pa.array(["x " * 50_000, " ".join(map(str, words))]), 24)
    assert at.tolist() == [0, 1, 2] and [x.tolist() for x in found] == [[0, 2_000], [50_000, 26_000], [1, period]]


def test_suffixes():
    rng = np.random.default_rng(9)
    for _ in range(60):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(2, 40)).astype(np.int32)
        found, n = periodic.Suffixes(s), len(s)
        assert np.argsort(found.rank).tolist() == sorted(range(n), key=lambda k: s[k:].tolist())
        i, j = np.array([(a, b) for a in range(n) for b in range(n) if a != b]).T
        want = [next((k for k in range(n - max(a, b)) if s[a + k] != s[b + k]), n - max(a, b)) for a, b in zip(i, j)]
        assert found.common(i, j).tolist() == want


def test_words_that_share_a_hash():
    h = np.array([[5, 5, 5, 9], [1, 2, 1, 1]], np.uint64)
    one, two, three, four = periodic.symbols(h)
    assert one == three and len({one, two, four}) == 3


def plant(i, text):
    w = WORDS.findall(text or "")
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def expected(i, text):
    words = plant(i, text)
    found = brute_runs(words)
    best = min(found, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{n},{p}\n" for a, n, p in found)), sha(collapsed(words, found))


def test_periodic_runs_of_the_query(spark):
    rows = [r for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r) for r in queries.op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(rows)
    short = [(i, t) for i, t in rows if len(t or "") < 20_000]
    assert len(short) > 150
    for i, t in short:
        assert got[i] == expected(i, t)


def test_periodic_runs_of_odd_rows(spark):
    line = "a b\tc\nD é\r"
    rows = [(None, line * 9), (3, None), (3, ""), (4, " \n"), (5, "x " * 25), (5, "x " * 25), (6, "x " * 23), *((i, line * 7 + f"{i} tail") for i in range(10, 40))]
    got = periodic.digests(periodic.periodic_runs(periodic.planted(frame(spark, rows))))
    assert Counter(map(tuple, got.collect())) == Counter(expected(i, t) for i, t in rows)
    assert periodic.periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame(spark, rows), shortest=2)
