"""Global order, the prefix trie, importance resampling and the Jaccard join against plain computations."""

import hashlib
import math
import random
import re
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuegrain.llm import jaccard, order, prefix_trie, resample

EXTRA = "node long, root long, _key string, place long"


# Order


@pytest.fixture(scope="module")
def shuffled(spark):
    values = list(range(3000)) + [7] * 1500  # a third of all rows is one key
    random.Random(1).shuffle(values)
    return spark.createDataFrame([(v, v % 5) for v in values], "v long, w long").repartition(7)


def test_places_in_a_sort(shuffled):
    rows = sorted((r["place"], r["v"]) for r in order.numbered(shuffled, [F.col("v").desc()]).collect())
    assert [p for p, _ in rows] == list(range(4500))
    assert [v for _, v in rows] == sorted((v for _, v in rows), reverse=True)


def test_running_sums_over_several_levels_of_chunks(spark):
    own = spark.range(300).select("id", (F.col("id") % 7).alias("w"), F.lit(1).cast("long").alias("one"))
    for r in order.running(own, "id", ["w", "one"], bits=2).collect():
        assert r["one"] == r["id"] + 1 and r["w"] == sum(i % 7 for i in range(r["id"] + 1))


@pytest.mark.parametrize("n", [0, 1, 2, 700])
def test_places_in_a_list(spark, n):
    ids = list(range(n))
    random.Random(2).shuffle(ids)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, [*ids[1:], None])], "id long, next long")
    assert {r["id"]: r["place"] for r in order.list_places(links, base=8).collect()} == {a: i for i, a in enumerate(ids)}


# Prefix trie


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), (role, text)))
    whole = {}
    for c in own:
        h = crc32(str(c).encode()) % 9
        cut = lambda x: [t[-1] for t in sorted(own.get(x, []))]
        whole[c] = tuple(cut(c - int(math.fmod(c, 5)))[:h] + cut(c)[h:])
    members = defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    ends = lambda k: hashlib.sha256(",".join(str(c) for c in sorted(members[k]) if whole[c] == k).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], ends(k)) for k, m in members.items())


def conversations():
    rng, rows = random.Random(3), []
    for c in range(60):
        for t in range(rng.randrange(0, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["ä hi", "", None, "yes", "x" * 50])))
    rows += [(100, None, "user", "first"), (100, None, "user", "first"), (100, 3, "user", "b"), (100, 3, "user", "a")]  # null and equal turns
    rows += [(c, t, "user", f"t{t % 9}") for c in (200, 205, 210) for t in range(150 + c % 7)]  # more turns than a block holds, many shared
    rows += [(None, 0, "user", "lost"), (-3, 0, "user", "below zero"), (-5, 0, "user", "below")]
    rows += [(1000 + i, 0, "system", "same") for i in range(300)]  # a hot first turn
    return rows


def trie_rows(df):
    return sorted(tuple(r) for r in df.collect())


def key(r):
    return tuple((x is not None, x) for x in r)


def test_trie_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "list_places", lambda links: order.list_places(links, base=64))
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 3)
    rows = conversations()
    made = spark.createDataFrame([(*r, 1, 2, "k", 3) for r in rows], f"conv_id long, turn long, role string, text string, {EXTRA}").repartition(5)
    assert sorted(map(tuple, prefix_trie.trie(made).collect()), key=key) == sorted(plain_trie(rows), key=key)


def test_trie_of_no_conversation_has_no_node(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.trie(spark.createDataFrame([], schema)).count() == 0
    assert prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0


# Importance resampling


def test_byte_table_cuts_as_the_pattern_does():
    text = "".join(map(chr, range(0x250))) + "Ünï Code-SPLIT_it"
    assert text.encode().translate(resample.TABLE).split() == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]


def test_longer_features_go_on_from_shorter_ones():
    words, found = resample.buckets_of("One two, two", 3)
    grams = ["one", "two", "two", "one two", "two two", "one two two"]
    expected = defaultdict(int)
    for g in grams:
        expected[crc32(g.encode()) % resample.BUCKETS] += 1
    assert words == 3 and found == dict(expected)


def plain_resample(docs, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bucket = lambda w: crc32(w.encode()) % 10000
    s, t = defaultdict(int), defaultdict(int)
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for w in words(x):
                counts[bucket(w)] += 1
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        own = words(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in map(bucket, own))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    ranks = defaultdict(list)
    for n, r in enumerate(able[: 10 * len(able) // 100]):
        ranks[tuple(r)].append(n + 1)
    return sorted(((*r, ranks[tuple(r)].pop() if ranks[tuple(r)] else None) for r in out), key=key)


def resample_docs():
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma", "δέλτα", "e1"]) for _ in range(rng.randrange(0, 60)))) for i in range(150)]
    return docs + [(None, "alpha " * 30), (150, None), (151, ""), (152, "beta " * 20000)] + [(153, "gamma beta " * 20)] * 40  # repeated rows


def test_resampling_is_the_plain_one(spark):
    docs, target = resample_docs(), ["alpha alpha e1", None, "new words"]
    frame = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, score string, rank int").repartition(6)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    assert sorted(map(tuple, resample.judge(frame, items).collect()), key=key) == plain_resample(docs, target)
    drawn = resample.draw(frame, items)
    assert drawn.columns == frame.columns and drawn.count() == sum(r[4] is not None for r in plain_resample(docs, target))
    assert sorted(map(tuple, resample.judge(frame, items.limit(0)).collect()), key=key) == plain_resample(docs, [])
    assert resample.judge(frame.limit(0), items).count() == 0


# Jaccard join


def plain_join(docs):
    def shingles(text):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        least[find(i)] = min((x for x in (least.get(find(i)), k) if x is not None), default=None)
    return sorted(((k, len(sets[i]), least[find(i)] if sets[i] else k) for i, (k, _) in enumerate(docs)), key=key)


def joined_docs(seed, groups=12, copies=14):
    rng, docs = random.Random(seed), []
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyz")
    shared = [word() for _ in range(60)]  # a passage that a third of the documents hold
    for g in range(groups):
        base = [word() for _ in range(rng.randrange(20, 150))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):  # chains of near copies, some just below the limit
                own[rng.randrange(len(own))] = word()
            docs.append(" ".join(own if rng.random() < 0.7 else shared + own))
    docs += [None, "", " \t\n", "one", "ONE", "two words", "two  Words", "x " * 3000, "y z " * 2000, docs[0].upper()]
    rng.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)] + [(None, docs[3]), (None, None), (5, docs[5]), (5, docs[5])]


@pytest.mark.parametrize("region", [256, 4])
def test_join_is_the_plain_one(spark, region):
    docs = joined_docs(5)
    frame = spark.createDataFrame([(i, t, 1, 2, "k", 3) for i, t in docs], f"doc_id long, text string, {EXTRA}").repartition(5)
    assert sorted(map(tuple, jaccard.judge(frame, region=region).collect()), key=key) == plain_join(docs)


def test_join_of_nothing(spark):
    schema = "doc_id long, text string"
    assert jaccard.judge(spark.createDataFrame([], schema)).count() == 0
    assert sorted(map(tuple, jaccard.judge(spark.createDataFrame([(1, None), (2, None), (3, "")], schema)).collect())) == [(1, 0, 1), (2, 0, 2), (3, 0, 3)]


def test_window_holds_the_lowest_common_shingle():
    rng = random.Random(6)
    for _ in range(300):
        n = rng.randrange(1, 200)
        x = set(rng.sample(range(1000), n))
        y = set(x)
        for v in rng.sample(sorted(x), n // 20):
            y.discard(v)
            y.add(1000 + v)
        if 100 * len(x & y) >= 90 * len(x | y):
            low = min(x & y)
            assert all(low in sorted(s)[: jaccard.window_size(len(s), 90)] for s in (x, y))


def test_cells_keep_near_nodes_together(spark):
    rng = np.random.default_rng(7)
    base = rng.poisson(3, (6, jaccard.SKETCH))
    counts = [np.maximum(0, b + (rng.random(jaccard.SKETCH) < 0.03)) for b in base for _ in range(40)]
    none = np.zeros(jaccard.FIRST, "<u8").tobytes()
    nodes = spark.createDataFrame([(i, int(c.sum()), none + c.astype("<u2").tobytes()) for i, c in enumerate(counts)], "node long, n int, sketch binary")
    rows = spark.createDataFrame([(1, i, i, 0, int(math.log(c.sum()) / math.log(100 / 90))) for i, c in enumerate(counts)], jaccard.ROWS)
    expected = {(i, j) for j in range(len(counts)) for i in range(j) if 100 * np.minimum(counts[i], counts[j]).sum() >= 90 * np.maximum(counts[i], counts[j]).sum()}
    assert len(expected) > 100
    for region in (8, 50, 1000):
        assert {(r["a"], r["b"]) for r in jaccard.near_in_regions(rows, nodes, 90, region).collect()} == expected
