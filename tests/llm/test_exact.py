"""Exact dedup, n-gram Jaccard components, substring dedup, fingerprints and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import exact_dedup, fingerprints, jaccard, mixing, queries, shared, substring_dedup, wordhash
from tallyloom.llm.shared import stash
from tallyloom.sources import scratch

DATA = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, keep_id string, n_words string, key int, tile int, size int, draw string, at int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, "x", "x", 1, 1, 1, "x", 1) for i, t in rows], CLASH)


def family(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "日本", "the", "The"]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 20, 70, 90, 150, 400]))] for _ in range(12)]
    out = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append((i * 3 + 1, rng.choice([" ", "\n", "\t "]).join(words)))
    return out + [(500, None), (501, ""), (502, "  \n"), (503, "one"), (504, "ONE"), (505, "w1 " * 30_000)]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    assert Counter(map(tuple, got.select(*order).collect())) == Counter(con.sql(queries.ORACLES[name]).select(*order).fetchall())


@pytest.mark.parametrize("top,tracked", [(256, 1024), (1, 8)])
def test_exact_dedup(spark, top, tracked):
    rows = [*family(), (7, "AbC"), (9, "aBc"), (9, "aBc"), (11, "ÄBC"), (12, "äbc"), (None, "abc"), (None, "alone"), *((1000 + i, "hot") for i in range(90))]
    norm = lambda t: (t or "").translate(LOWER)
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(frame(spark, rows), top, tracked).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = [i for i in groups[text] if i is not None]
        assert r["keep_id"] == max(ids, default=None) and r["group_size"] == len(groups[text])
        assert r["doc_id"] == r["keep_id"] or not r["kept"]
    assert sum(r["kept"] for r in got) == len(groups)
    docs = frame(spark, rows).withColumnsRenamed({"n_words": "sha", "tile": "row", "size": "group_size"})
    kept = exact_dedup.deduplicated(docs, top, tracked)
    assert kept.columns == docs.columns and Counter((r["doc_id"], norm(r["text"])) for r in kept.collect()) == Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


def shingles(text, width):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute_components(rows, width, share):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    return Counter((doc, len(sets[i]), min((d for d in ids[find(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("width,share", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_components(spark, width, share):
    rows = [*family(5, 90), (1, "repeated id with another text of some more words"), (None, "no id here but text"), (None, "NO id here but text")]
    got = jaccard.jaccard_components(frame(spark, rows), width, share).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, width, share)
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


def test_jaccard_finds_links_that_the_leader_does_not_have(spark):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(300)]
    rows, at = [], list(words)
    for i in range(40):  # a chain: neighbours are linked, distant ones aren't
        rows.append((i, " ".join(at)))
        for _ in range(3):
            at[rng.randrange(300)] = f"n{i}{rng.random()}"
    assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows), 4, 85).collect())) == brute_components(rows, 4, 85)


def thue_morse(bits, first, second):
    """Two words that any polynomial hash modulo 2 ** 64 takes for equal."""
    a, b = first, second
    for _ in range(bits):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomial_hashes_confuse(spark):
    rows = []
    for k, bits in enumerate((3, 5, 10, 11, 13)):
        a, b = thue_morse(bits, "a", "b")
        common = " ".join(f"c{k}_{i}" for i in range(12))
        rows += [(10 * k + i, t) for i, t in enumerate([a, b, f"{common} {a}", f"{common} {b}", f"{a} {b} {a} {b}", f"{b} {a} {b} {a}"])]
    assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows), 4, 85).collect())) == brute_components(rows, 4, 85)
    got = substring_dedup.substring_dedup(frame(spark, rows), 13).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_substrings(rows, 13)


@pytest.mark.parametrize("share,width", [(85, 4), (80, 5), (50, 2)])
def test_jaccard_recall_at_the_threshold(spark, share, width):
    """Of pairs that are linked by as little as can be, of all sizes, none is lost; nor is one just below found."""
    rng, rows = random.Random(share), []
    for k, n in enumerate([*range(4, 40, 3), 63, 64, 65, 100, 127, 128, 129, 255, 256, 300, 600, 2000]):
        words = [f"w{k}_{i}" for i in range(n)]
        for extra in range(1, 2 * n):  # words put in front of the copy, until it is no longer linked
            if 100 * (n - width + 1) < share * (n - width + 1 + extra):
                break
        for j, more in enumerate((extra - 1, extra)):
            base = [w + f"_{j}" for w in words]
            rows += [(10 * k + 2 * j, " ".join(base)), (10 * k + 2 * j + 1, " ".join([f"x{rng.random()}" for _ in range(more)] + base))]
    want = brute_components(rows, width, share)
    assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows), width, share).collect())) == want
    assert len({c for _, _, c in want}) > len(rows) // 2


def test_jaccard_of_many_texts_with_a_common_line(spark, monkeypatch):
    rng = random.Random(8)
    line = " ".join(f"licence{i}" for i in range(20))
    rows = [(i, line + " " + " ".join(f"u{rng.random()}" for _ in range(25))) for i in range(3000)]
    tested = []
    monkeypatch.setattr(jaccard, "bounded", lambda pairs, *a, f=jaccard.bounded: (tested.append(pairs.count()), f(pairs, *a))[1])
    for name in ("close_pairs", "lopsided_pairs"):
        monkeypatch.setattr(jaccard, name, lambda tiles, *a, f=getattr(jaccard, name): (tested.append(tiles.count()), f(tiles, *a))[1])
    monkeypatch.setattr(jaccard, "few_pairs", lambda *a, f=jaccard.few_pairs: (tested.append(f(*a).count()), f(*a))[1])
    got = jaccard.jaccard_components(frame(spark, rows), 4, 85).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got) and sum(tested) <= 3000


def test_hot_tiles_are_divided_without_losing_links(spark, monkeypatch):
    """Texts of a few common passages each: many share n-grams that no order can avoid."""
    for name, value in (("FEW", 2), ("HOT", 4), ("BLOCK", 2), ("ROUNDS", 1)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(12)
    passages = [" ".join(f"p{k}_{i}" for i in range(rng.choice([5, 9, 12]))) for k in range(8)]
    rows = [(i, " ".join(rng.sample(passages, rng.choice([1, 2, 3, 4])))) for i in range(120)] + [(200 + i, f"a b{i % 7}") for i in range(20)]
    for width, share in ((4, 85), (2, 50)):
        assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows), width, share).collect())) == brute_components(rows, width, share)


def test_only_texts_of_near_pairs_are_written(spark, monkeypatch):
    rng = random.Random(5)
    line = [f"common{i}" for i in range(12)]
    rows = [(i, " ".join([f"u{rng.randrange(10**9)}" for _ in range(60)] + line)) for i in range(200)]
    rows += [(1000 + i, t + " more") for i, t in rows[:3]] + [(None, rows[3][1] + " more")]
    written = []
    monkeypatch.setattr(jaccard, "stash", lambda df, tag: (out := stash(df, tag), written.append((tag, df.columns, out.count())))[0])
    for sent in (1_000_000, 0):
        monkeypatch.setattr(jaccard, "SENT", sent)
        written.clear()
        got = jaccard.jaccard_components(frame(spark, rows), 4, 85).collect()
        assert Counter(map(tuple, got)) == brute_components(rows, 4, 85)
        assert not [tag for tag, columns, _ in written if "text" in columns]
        assert max(n for tag, _, n in written if tag == "hashes") == 8


def test_components_of_links(spark):
    links = [(1, 2), (2, 1), (2, 3), (3, 3), (9, 9), (5, 7), (5, 7), *((100 + i, 101 + i) for i in range(40))]
    got = {r["key"]: r["label"] for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, **{100 + i: 100 for i in range(41)}}


def test_stars_of_links():
    rng = np.random.default_rng(3)
    for n, m in [(2, 1), (50, 30), (400, 380), (1000, 3000)]:
        u, v = rng.permutation(10 * n)[rng.integers(0, n, (2, m))]
        label = {k: k for k in {*u.tolist(), *v.tolist()}}
        for _ in range(n):
            before = dict(label)
            for a, b in zip(u.tolist(), v.tolist()):
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                break
        keys, least = jaccard.stars(u, v)
        assert dict(zip(keys.tolist(), least.tolist())) == {k: x for k, x in label.items() if k != x}
    assert [len(x) for x in jaccard.stars(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


@pytest.mark.parametrize("parts", [1, 7])
def test_components_take_few_rounds(spark, monkeypatch, parts):
    """Tasks connect what they hold, so that a chain is done in few steps over shuffled rows, in one task in none."""
    written, stash = [], jaccard.stash
    monkeypatch.setattr(jaccard, "stash", lambda df, tag: written.append(tag) or stash(df, tag))
    links = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long").coalesce(1).repartition(parts)
    assert {r["key"]: r["label"] for r in jaccard.components(links).collect()} == dict.fromkeys(range(201), 0)
    assert len(written) <= (3 if parts == 1 else 7)


def test_few_shuffles_of_pairs(spark, monkeypatch):
    """The keys of pairs are found without a shuffle, and open tiles are looked at once while labels stay as they are."""
    pairs = spark.range(0, 1000, 1, 3).select((F.col("id") % 7).alias("a"), (F.col("id") % 5 + 10).alias("b"))
    keys = jaccard.ends_of(pairs)
    assert {r["key"] for r in keys.collect()} == {*range(7), *range(10, 15)} and keys.count() <= 3 * 12
    assert "Exchange" not in keys._jdf.queryExecution().toString()
    looked, undecided = [], jaccard.undecided
    monkeypatch.setattr(jaccard, "undecided", lambda told: looked.append(1) or undecided(told))
    rows = [(i, "a b c d e f " + " ".join(f"w{i}x{k}" for k in range(20))) for i in range(30)] + [(99, "p q r s t"), (98, "p q r s t u")]
    assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows), 4, 50).collect())) == brute_components(rows, 4, 50)
    assert len(looked) == 1


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(0)
    for n, m, both in [(100, 90, 50), (300, 280, 270), (64, 64, 64), (1000, 30, 20)]:
        a = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        x, y = np.sort(a[:n]), np.sort(np.concatenate([a[:both], a[n : n + m - both]]))
        p, q = jaccard.bitmap(x), jaccard.bitmap(y)
        size = min(len(p), len(q))
        differ = int(np.bitwise_count(jaccard.fold(p, size) ^ jaccard.fold(q, size)).sum())
        assert jaccard.overlap(x, y) == both and differ <= n + m - 2 * both


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b\x0c\r\x1c\x85é日", max_size=40), min_size=1, max_size=5), st.booleans())
def test_word_hashes(texts, lower):
    texts = [*texts, "x" * 100 + " y" if len(texts) % 2 else "y"]
    data, offsets = wordhash.text_bytes(pa.array(texts))
    h, starts, ends, first = wordhash.words(data, offsets, lower)
    words = [w for t in texts for w in WORDS.findall(t.translate(LOWER) if lower else t)]
    assert [bytes(data[s:e]).decode().translate(LOWER if lower else {}) for s, e in zip(starts, ends)] == words
    both = list(zip(*h.tolist()))
    assert len(set(zip(both, words))) == len(set(words)) == len(set(both)) == len(set(h[0].tolist())) == len(set(h[1].tolist()))
    short = tuple(wordhash.words(*wordhash.text_bytes(pa.array(["y"])), lower)[0][:, 0].tolist())
    assert all(x == short for x, w in zip(both, words) if w == "y")


def brute_substrings(rows, width):
    first = {}
    texts = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in texts:
        gone = {p for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("width,gram", [(13, 6), (5, 2)])
def test_substring_dedup(spark, width, gram):
    rows = family(11, 80)
    rng = random.Random(2)
    passage = " ".join(f"p{rng.randrange(30)}" for _ in range(60))
    rows += [(2000 + i, f"{' '.join(f'u{rng.random()}' for _ in range(5))} {passage} {i} {passage}") for i in range(15)]
    got = substring_dedup.substring_dedup(frame(spark, rows), width, gram).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_substrings(rows, width) and len(got) == len(rows)
    assert substring_dedup.substring_dedup(frame(spark, [])).collect() == []


def test_copies_go_by_what_the_index_finds(spark, monkeypatch):
    rng = random.Random(8)
    text = " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(60))
    rows = [(5, text), (6, text), (7, text.replace(" ", "\n")), (7, "x " + text), (9, text + " y"), (2, "a b"), (3, "a b")]
    removed = lambda: sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.substring_dedup(frame(spark, rows)).collect())
    assert removed() == [(2, 2, 0), (3, 2, 0), (5, 60, 0), (6, 60, 60), (7, 60, 60), (7, 61, 60), (9, 61, 60)]
    monkeypatch.setattr(substring_dedup, "repeated_windows", lambda runs, width, f=substring_dedup.repeated_windows: f(runs, width).where("1 = 0"))
    assert all(n == 0 for _, _, n in removed())


def test_substring_dedup_of_repeated_and_null_ids(spark):
    text = " ".join(f"a{i}" for i in range(20))
    got = substring_dedup.substring_dedup(frame(spark, [(1, text), (1, text), (None, text), (2, "b " + text)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 20)]


def test_heavy_anchors_are_divided(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HEAVY", 3)
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(13)]
    rows = [(i, " ".join([*(f"u{rng.randrange(4)}" for _ in range(rng.randrange(9))), *passage, *(f"u{rng.randrange(4)}" for _ in range(rng.randrange(9)))])) for i in range(60)]
    rows += [(100 + i, "a " * (13 + i)) for i in range(12)] + [(200 + i, " \t ".join([*passage[: 6 + i % 7], "x", *passage])) for i in range(9)]
    seen = []
    monkeypatch.setattr(substring_dedup, "divided", lambda runs, width, gram, k, f=substring_dedup.divided: (seen.append(k), f(runs, width, gram, k))[1])
    got = substring_dedup.substring_dedup(frame(spark, rows), 13, 6).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == brute_substrings(rows, 13)
    assert seen[:2] == [2, 3]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=6, max_size=60), st.integers(2, 5))
def test_fm_index_counts_like_a_search(values, depth):
    sequence = np.array([*values, 0])
    index = substring_dedup.FMIndex(sequence, depth + 1, np.arange(len(sequence)))
    last = np.arange(depth - 1, len(values))
    length, low, high = index.search(sequence, last, depth)
    for end, n, a, b in zip(last, length, low, high):
        here = values[end - depth + 1 : end + 1]
        found = [k for k in range(len(values) - depth + 1) if values[k : k + depth] == here]
        if n == depth:
            assert sorted(index.owners[a:b].tolist()) == found
            assert index.first_owners(np.array([a, a]), np.array([b, b])).tolist() == [found[0]] * 2
        else:
            assert len(found) == 1


def features(text):
    """A model of the features, line by line: hashes as Spark chains them."""
    out = Counter()
    seed = xxhash.xxh64_intdigest((9).to_bytes(4, "little"), 42)
    for line in text.split("\n"):
        out["line", line] += 1
        for k in range(len(line) - fingerprints.GRAM + 1):
            w = line[k : k + fingerprints.GRAM]
            if xxhash.xxh64_intdigest(w.encode(), seed) % fingerprints.EACH == 0:  # EACH divides 2 ** 64
                out[w] += 1
    return out


def cosine(a, b):
    x, y = features(a), features(b)
    return sum(n * y[k] for k, n in x.items()) / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5


def test_fingerprints(spark):
    rows = [*family(7, 30), (900, "a\nb\nc"), (901, "c\na\nb"), (902, "a\nb"), (903, "a\nb\nc"), (900, "a\nb\nc"), (904, "long " * 20_000), (905, "日本語のテキスト。" * 9), (None, "none"), (None, "nil"), (904, "other"), (None, "none")]
    rows = [(i, t) for i, t in rows if i != 505]
    key = lambda i, t: hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()
    got = defaultdict(list)
    result = fingerprints.edited(frame(spark, rows)).collect()
    for r in result:
        got[r["doc_id"], r["n_chars"]].append(r)
    assert Counter((r["doc_id"], r["n_chars"]) for r in result) == Counter((i, len(t or "")) for i, t in rows)
    order = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, key(*x)), reverse=True)
    by_text = defaultdict(set)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = next(r for r in got[i, len(t)] if r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest())
        by_text[t].add(r["fingerprint"])
        by_text[edited].add(r["edited_fingerprint"])
        assert abs(r["near_edited"] - cosine(t, edited)) < 0.3 and abs(r["near_next"] - cosine(t, following)) < 0.3
    assert all(len(x) == 1 for x in by_text.values())
    one = lambda i, n: got[i, n][0]["fingerprint"]
    assert one(900, 5) == one(901, 5) == one(903, 5) != one(902, 3)
    plain = Counter(map(tuple, fingerprints.fingerprints(frame(spark, rows)).collect()))
    assert plain == Counter((r["doc_id"], r["fingerprint"]) for r in result)
    assert fingerprints.edited(frame(spark, [])).collect() == []
    single = fingerprints.edited(frame(spark, [(1, "abcdef")])).first()
    assert single["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def likeness_of(spark, pairs):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").repartition(4)
    made = [fingerprints.vectors(rows.select("k", F.col(c).alias("t")), "k", "t").select("k", *(F.col(n).alias(f"{c}_{n}") for n in fingerprints.VECTOR)) for c in "ab"]
    both = made[0].join(made[1], "k").select("k", *(x for p in ("a_", "b_") for x in (fingerprints.as_text(p).alias(p + "text"), fingerprints.sketch(p).alias(p + "lanes"))))
    return [r[1] for r in both.select("k", fingerprints.likeness("a_", "b_")).orderBy("k").collect()]


def test_likeness_is_near_the_exact_overlap(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstuy") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(n))
    pairs = []
    for n in (60, 300, 2000):
        for _ in range(8):
            a, b = text(n), text(n)
            pairs += [(a, "!" + a), (a, "x" + a), (a, a[: len(a) // 2] + " put in " + a[len(a) // 2 :]), (a, b), (a, a[: 2 * len(a) // 3] + b[: len(a) // 3]), (a, a + "\n" + b)]
    got, want = likeness_of(spark, pairs), [cosine(a, b) for a, b in pairs]
    error = np.array(got) - np.array(want)
    assert np.sqrt((error**2).mean()) < 0.09 and np.abs(error).max() < 4 * 0.09
    assert min(x for x, w in zip(got, want) if w > 0.9) > 0.75 and np.mean([x for x, w in zip(got, want) if w < 0.1]) < 0.12


ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz  ", "cyrillic": "абвгдежзийклмнопрстуфхцчшщыьэюя  ", "cjk": "".join(map(chr, range(0x4E00, 0x4E00 + 900))), "devanagari": "".join(map(chr, range(0x905, 0x940))) + " ", "thai": "".join(map(chr, range(0xE01, 0xE2F))), "tamil": "அஆஇஈஉஊஎஏகஙசஞடணதநபமயரல ", "georgian": "".join(map(chr, range(0x10D0, 0x10F1))) + " ", "acgt": "ACGT", "emoji": "".join(map(chr, range(0x1F600, 0x1F640)))}


def test_a_character_in_front_changes_little_in_any_script(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(letters) for _ in range(6000)) for letters in ALPHABETS.values()]
    for front in ("!", "x", "字"):
        assert min(likeness_of(spark, [(t, front + t) for t in texts])) >= 0.95
    assert max(likeness_of(spark, list(zip(texts, texts[1:])))) < 0.4


def test_pieces_of_long_lines_lose_no_window(spark, monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("abc 日😀") for _ in range(500))
    rows = spark.createDataFrame([("x", text)], "k string, t string")
    whole = fingerprints.vectors(rows, "k", "t").collect()
    monkeypatch.setattr(fingerprints, "PIECES", rf"(?s)(?=(.{{1,{7 + fingerprints.GRAM - 1}}})).{{1,7}}")
    assert fingerprints.vectors(rows, "k", "t").collect() == whole
    assert whole[0]["pieces"] == sum(features(text).values())


def test_fingerprints_of_a_text_of_over_25_mb(spark):
    """Lanes hold more than 2 ** 20 features; repeated rows are divided lane by lane."""
    long = "end " * 7_000_000
    near = likeness_of(spark, [(long, long + "and more"), (long, "other words " * 1000)])
    assert near[0] > 0.99 and near[1] < 0.4
    rows = spark.createDataFrame([(k, t) for k, t in (("a", "one and two\nthree"), ("b", "four and five")) for _ in range(3)], "k string, t string")
    once = fingerprints.vectors(rows.dropDuplicates(), "k", "t").drop("repeats").collect()
    assert sorted(once) == sorted(fingerprints.vectors(rows, "k", "t").drop("repeats").collect())


def test_paragraphs_are_inserted_and_deleted(spark):
    rows = spark.createDataFrame([("ab", "x\ny\nz"), ("a", "x\ny"), ("b", "z")], "k string, t string")
    v = fingerprints.vectors(rows, "k", "t")
    pick = lambda k, p: v.where(F.col("k") == k).select(*(F.col(c).alias(p + c) for c in fingerprints.VECTOR))
    whole = tuple(v.where("k = 'ab'").select(*fingerprints.VECTOR).first())
    both = pick("a", "a_").join(pick("b", "b_"))
    assert tuple(both.select(*fingerprints.combine("a_", "b_")).first()) == whole
    less = pick("ab", "a_").join(pick("b", "b_"))
    assert tuple(less.select(*fingerprints.combine("a_", "b_", -1)).first()) == tuple(v.where("k = 'a'").select(*fingerprints.VECTOR).first())


def test_targets_are_capped_and_shared_anew():
    assert mixing.targets([100, 100, 100], 1.5) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.targets([0, 0], 1.5) == [0, 0] and mixing.targets([], 1.5) == []
    got = mixing.targets([10, 1000, 5, 40], 1.5)
    assert all(g <= 2 * s + 1e-9 for g, s in zip(got, [10, 1000, 5, 40])) and sum(got) == pytest.approx(1.5 * 1055)


def best_cost(patterns, want, most):
    """Least cost of the greatest flow, one word at a time along cheapest augmenting paths (Bellman-Ford)."""
    names = sorted({s for p, _ in patterns for s in p})
    edges = []  # from, to, capacity, cost

    def add(a, b, cap, cost):
        edges.append([a, b, cap, cost])
        edges.append([b, a, 0, -cost])

    for i, (p, n) in enumerate(patterns):
        for k in range(most):
            add("start", ("p", i), n, k)
        for s in p:
            add(("p", i), ("s", s), 10**6, 0)
    for s in names:
        add(("s", s), "end", want.get(s, 0), 0)
    flow = cost = 0
    while True:
        dist, via = {"start": 0}, {}
        for _ in range(len(edges)):
            changed = False
            for k, (a, b, cap, c) in enumerate(edges):
                if cap and a in dist and dist[a] + c < dist.get(b, 10**9):
                    dist[b], via[b], changed = dist[a] + c, k, True
            if not changed:
                break
        if "end" not in dist:
            return flow, cost
        at = "end"
        while at != "start":
            k = via[at]
            edges[k][2] -= 1
            edges[k ^ 1][2] += 1
            at = edges[k][0]
        flow, cost = flow + 1, cost + dist["end"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("abc"), min_size=1).map(frozenset), st.integers(0, 6)), min_size=1, max_size=4), st.dictionaries(st.sampled_from("abc"), st.integers(0, 9)), st.integers(1, 3))
def test_route_is_a_min_cost_flow(patterns, want, most):
    flow = mixing.route(patterns, want, most)
    used = [sum(x for (i, _), x in flow.items() if i == k) for k in range(len(patterns))]
    assert all(x >= 0 for x in flow.values()) and all(u <= most * n for u, (_, n) in zip(used, patterns))
    assert all(sum(x for (_, s), x in flow.items() if s == name) <= want.get(name, 0) for name in "abc")
    cost = sum(k * max(0, min(u - k * n, n)) for u, (_, n) in zip(used, patterns) for k in range(most))
    assert (sum(used), cost) == best_cost(patterns, want, most)


def test_parts_of_texts_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"a{i} b c d", "s", 1, 2, 3, 4) for i in [*range(9), None, None, 3]], "doc_id long, text string, source string, key int, taken int, size int, part int")
    mixed = mixing.mix(docs, F.array("source"), 1.3)
    out = mixing.repeated(docs, mixed)
    assert out.columns == docs.columns and abs(sum(len(r["text"].split()) for r in out.collect()) - sum(r["taken"] for r in mixed.collect())) <= 2
    assert {r["text"] for r in out.collect()} <= {r["text"] for r in docs.collect()}


def test_mixing(spark):
    rows = [(i, "w " * (i % 17), ["a", "b", None, "Ä"][i % 4]) for i in range(200)] + [(900, None, "b"), (901, "x y", "b"), (901, "x y", "b"), (902, "y " * 3000, "a")]
    docs = spark.createDataFrame([(i, t, s, len(t or "")) for i, t, s in rows], "doc_id long, text string, source string, n_chars long")
    mixed = mixing.mix(docs, F.array("source"))
    got = mixed.collect()
    assert len(got) == len(rows)
    taken, size, target = Counter(), Counter(), {}
    for r in got:
        s = r["sources"][0]
        taken[s] += r["taken"]
        size[s] += r["size"]
        target[s] = r["targets"][0]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_sizes"][0] == sum(len((t or "").split()) for _, t, x in rows if x == s)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    order = sorted(target, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixing.targets([size[s] for s in order]))
    again = mixing.mix(docs.repartition(7), F.array("source")).collect()
    assert Counter(map(str, again)) == Counter(map(str, got))
    out = mixing.repeated(docs, mixed)
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len((r["text"] or "").split())
        assert r["n_chars"] == len(r["text"])
    for r in got:  # the one document of each source that is taken in part is taken whole or not
        words[r["sources"][0]] -= (2 * r["taken"] + r["size"]) // (2 * r["size"]) * r["size"] if r["size"] else 0
    assert out.columns == docs.columns and {r["text"] for r in out.collect()} <= {t for _, t, _ in rows}
    assert not any(words.values())
    assert mixing.mix(docs.limit(0), F.array("source")).collect() == []


def test_mixing_of_overlapping_sources(spark):
    rows = [(1, "a " * 10, ["x", "y"]), (2, "a " * 10, ["x"]), (3, "a " * 10, ["y", "z"]), (4, "a " * 5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, names array<string>")
    got = {r["doc_id"]: r for r in mixing.mix(docs, F.col("names")).collect()}
    assert all(r["taken"] <= 2 * r["size"] for r in got.values()) and got[1]["source_sizes"] == [20, 20]


def test_scratch_survives_and_is_read_back(spark):
    df = stash(spark.range(5), "t")
    assert sorted(r[0] for r in df.collect()) == list(range(5)) and stash(spark.range(0), "t").count() == 0


def test_near_copies_are_kept_by_row(spark):
    text = lambda name, last="": " ".join(f"{name}{i}" for i in range(60)) + last
    rows = [
        (None, text("alone")), (None, text("nulls")), (None, text("nulls", " x")), (None, text("mixed")), (20, text("mixed", " x")),
        (7, text("same")), (7, text("same", " x")), (3, text("other")), (7, text("other", " x")), (7, text("unique")),
        (30, text("twice")), (30, text("twice")), (None, text("null twice")), (None, text("null twice")), (40, ""), (41, None), (None, " \n"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.keep_one_near_copy(spark, docs, DATA)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], (r["text"] or " ").split("0")[0].strip()) for r in out.collect())
    assert got == Counter([(None, "alone"), (None, "nulls"), (20, "mixed"), (7, "same"), (3, "other"), (7, "unique"), (30, "twice"), (None, "null twice"), (40, ""), (41, ""), (None, "")])
    again = corpus_pipeline.keep_one_near_copy(spark, docs.repartition(7), DATA)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))


def test_near_copies_are_linked_by_five_words_and_four_fifths(spark):
    words = [f"v{i}" for i in range(100)]
    moved = words[:40] + [f"u{i}" for i in range(6)] + words[46:]
    rows = [(1, " ".join(words)), (2, " ".join(words[:82])), (3, " ".join(words[:60]))]
    rows += [(4, " ".join(x.replace("v", "y") for x in words)), (5, " ".join(x.replace("v", "y") for x in moved))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    like = lambda i, j, width: len(shingles(rows[i][1], width) & shingles(rows[j][1], width)) / len(shingles(rows[i][1], width) | shingles(rows[j][1], width))
    assert all(0.8 <= like(i, j, 5) and like(i, j, 4) < 0.85 for i, j in ((0, 1), (3, 4))) and like(1, 2, 5) < 0.8
    assert sorted(r["doc_id"] for r in corpus_pipeline.keep_one_near_copy(spark, docs, DATA).collect()) == [1, 3, 4]


@pytest.mark.parametrize("overlap", [False, True])
def test_mixing_of_more_sources_than_the_network_holds(spark, overlap, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "w " * int(rng.paretovariate(0.7) % 500), [rng.choice([None, "Ä", "𝄞", "ﬁ", *(f"s{k}" for k in range(40))])]) for i in range(300)] + [(900, None, ["void"])]
    rows += [(1000, "a " * 70, ["s1", "s2"]), (1001, "a " * 9, ["extra", "s2"])] * overlap
    docs = spark.createDataFrame(rows, "doc_id long, text string, names array<string>")
    want = Counter(map(str, mixing.mix(docs, F.col("names")).collect()))
    monkeypatch.setattr(mixing, "PATTERNS", 8)
    assert Counter(map(str, mixing.mix(docs, F.col("names")).collect())) == want


def test_popular_ngrams_stay_last_as_the_corpus_grows(spark):
    """N-grams that ten of many texts share stand out too, so that tiles don't grow with the corpus."""
    rng = random.Random(3)
    lines = [" ".join(f"l{k}_{i}" for i in range(12)) for k in range(2000)]
    rows = [(i, " ".join([lines[i % 2000], *(f"u{rng.random()}" for _ in range(60))])) for i in range(20_000)]
    levels = jaccard.popular(frame(spark, rows), 4)
    tiles = Counter(t for s in jaccard.sets_of(pa.array([t for _, t in rows]), 4) for t in jaccard.filed(jaccard.in_order(s, levels), 85).tolist())
    assert max(tiles.values()) <= 4


def test_bitmaps_take_half_a_byte_a_hash_at_most():
    """Candidates carry them, so that they are most of what a join of pairs moves."""
    rng = np.random.default_rng(1)
    for n in (1, 31, 32, 100, 127, 128, 5000):
        s = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert max(n / 4, 16) <= len(jaccard.bitmap(s)) <= max(n / 2, 16)


def test_workers_drop_what_other_operators_keep():
    shared.kept["one"], shared.kept["two"] = {"a": 1}, {"b": 2}
    try:
        batch = pa.RecordBatch.from_arrays([pa.array(["x", "y"])], ["text"])
        assert sum(b.num_rows for b in shared.slices([batch], owner="two")) == 2
        assert shared.kept["one"] == {} and shared.kept["two"] == {"b": 2}
        list(shared.slices([batch]))
        assert shared.kept["two"] == {}
    finally:
        del shared.kept["one"], shared.kept["two"]


def test_stashed_queries_send_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    before = spark.conf.get(scratch.BATCH)
    big = spark.range(0, 300, 1, 1).selectExpr("repeat('x', 100000) AS text").mapInArrow(sizes, "n long")
    assert max(r["n"] for r in shared.stash(big, "sizes").collect()) < 6_000_000
    assert spark.conf.get(scratch.BATCH) == before
