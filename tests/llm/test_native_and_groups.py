"""URL filter, line dedup, quality, decontamination, SimHash and suffix dedup against plain Python on small fixtures."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from valuegrain.llm import decontaminate, quality, simhash, suffixes, units, url_filter

DOCS = "doc_id long, text string, n_words string, _key string"


def docs_of(spark, texts):
    """Documents with two extra columns whose names clash with outputs and helpers."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice(["th", "an", "er", "on", "re", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(90) for _ in range(3)]
    texts = [(i, say(rng.randint(1, 150))) for i in range(30)]
    texts += [(100 + i, f"{say(20)}\n{shared[i % 3]}\n{say(20)}") for i in range(12)]
    texts += [(200 + i, texts[i][1]) for i in range(4)] + [(300, None), (301, ""), (302, "  \n "), (303, "ab " * 400), (303, "ab " * 400), (304, "é" * 700), (305, shared[0])]
    return [*texts, (306, f"{say(12_000)}\n{shared[1]}\n{say(8_000)}")]  # a very long one


def test_url_rules_and_model(spark):
    rows = [
        (1, "http://a.COM/x?y"), (2, "https://example.com/en/1"), (3, "http://b.www.Example.com/en/1#a"), (4, "http://x.net/es/"), (5, "http://x.net/de/"), (6, None), (7, "no scheme"), (8, "http://com"), (9, "http://xcom/"),
        (10, "http://casino-win.example.org/de/1"), (11, "http://library.example.org/de/1"), (12, "ftp://h\n.com?q://z"), (1, "http://a.COM/x?y"),
    ]
    model = url_filter.fit(url_filter.labelled_urls(spark))
    df = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, model).collect()}
    assert got[1] == ("a.com", "/x", "com/", "allow") and got[2][2:] == ("example.com/en/", "block") and got[3][2:] == ("www.example.com/en/", "allow") and got[4][2:] == ("net/es/", "block") and got[5][2] is None
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8][:3] == ("com", "", None) and got[9][2] is None and got[12][:2] == ("h\n.com", "")
    assert got[10][3] == "block" and got[11][3] == "allow"
    assert url_filter.judge(df, model).count() == len(rows) and url_filter.judge(df.limit(0), model).count() == 0


def test_url_model_on_hosts_kept_out(spark):
    rows = [(r.url, r.label) for r in url_filter.labelled_urls(spark).collect()]
    host = lambda u: u.split("://")[1].split("/")[0].removeprefix("www.").removeprefix("m.").removeprefix("blog.")
    kept_out = [r for r in rows if zlib.crc32(host(r[0]).encode()) % 4 == 0]
    model = url_filter.fit(spark.createDataFrame([r for r in rows if r not in kept_out], "url string, label double"))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(kept_out)], "page_id long, url string")
    out = {r.page_id: r.verdict for r in url_filter.judge(pages, model, rules=()).collect()}
    right = [(out[i] == "block") == (y == 1.0) for i, (_, y) in enumerate(kept_out)]
    assert len(kept_out) > 300 and sum(right) >= 0.97 * len(right)


def test_url_parts_and_rules_equal_plain_ones(spark):
    rng = random.Random(9)
    urls = ["".join(rng.choice(["http://", "https://", "://", "Example.com", "www.", "net", "/es/", "/EN/", "/en/", "/fr/", "?", "#", ".", "/", "a", "B", "com", "É", " "]) for _ in range(rng.randint(0, 7))) for _ in range(1500)] + [None, "", "http://x.net/es/" + "a" * 5000]

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fit, key=lambda r: len(r.text), default=None)
        return (host, path, best.text if best else None, best.verdict if best else None)

    model = url_filter.fit(url_filter.labelled_urls(spark))
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), model).collect()
    assert len(out) == len(urls)
    for r in out:
        host, path, rule, verdict = plain(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))


def plain_dedup(rows, separator, run_words):
    """{(id, text): (removed, text)} by hand."""
    want, seen = {}, set()
    for i, t in sorted({(i, t) for i, t in rows}, key=lambda x: (x[0] is None, x[0], str(x[1]))):
        parts = re.split(f"({separator})", t or "")  # units and separators take turns
        at = list(itertools.accumulate([0, *map(len, parts)]))
        units = [(k, " ".join(parts[k].lower().split())) for k in range(0, len(parts), 2)]
        worded, again = [k for k, n in units if n], set()
        for k, norm in units:
            if norm and norm in seen:
                again.add(k)
            elif norm:
                seen.add(norm)
        gone, run = set(), []
        for k in [*worded, None]:
            if k in again:
                run.append(k)
                continue
            if sum(len(parts[x].split()) for x in run) >= run_words:
                gone |= set(run)
            run = []
        kept = [k for k in range(0, len(parts), 2) if k not in gone]
        text = "".join((parts[k - 1] if n else "") + parts[k] for n, k in enumerate(kept))
        want[i, t] = (",".join(f"{at[k]}:{at[k + 1]}" for k in sorted(gone)), None if t is None else text)
    return want


@pytest.mark.parametrize("unit,run_words", [("sentence", units.RUN_WORDS), ("line", 1), ("line", 15), ("paragraph", 6)])
def test_line_dedup(spark, prose, unit, run_words):
    rng = random.Random(31)
    lines = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 9))) + rng.choice([".", "!", "", "?"]) for _ in range(60)]
    made = [(400 + i, "".join(rng.choice(lines) + rng.choice([" ", "\n", "\n\n", "  ", " \n\t"]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows = [*prose, *made, *made[:3], (None, made[5][1]), (500, f"Intro. {prose[40][1]}. Outro é."), (501, f"Other {prose[40][1]}. Outro é."), (502, f" {made[7][1]} \n")]
    want = plain_dedup(rows, units.SEPARATORS[unit], run_words)
    out = units.judge(docs_of(spark, rows), unit=unit, run_words=run_words).collect()
    given = {}
    for i, t in rows:
        given.setdefault(i, []).append(want[i, t])
    assert len(out) == len(rows) and all((r.removed, r.text) in given[r.doc_id] for r in out)
    assert sum(r.n_removed > 0 for r in out) > 5 and all(r.n_removed == len(r.removed.split(",")) for r in out if r.removed)
    assert units.judge(docs_of(spark, rows).limit(0), unit=unit).count() == 0
    whole = units.dedup(docs_of(spark, rows).withColumn("removed", F.lit(1)), unit=unit)
    assert whole.columns == ["doc_id", "text", "n_words", "_key", "removed"] and dict(whole.dtypes)["removed"].startswith("array")


def test_units_of_any_length_and_paragraphs(spark):
    texts = [(1, "a b\nshort line\n\nA  b"), (2, "short line\nx\n "), (3, "x"), (4, None)]
    out = {r.doc_id: (r.removed, r.text) for r in units.judge(docs_of(spark, texts), unit="line", run_words=1).collect()}
    assert out == {1: ("16:20", "a b\nshort line\n"), 2: ("0:10", "x\n "), 3: ("0:1", ""), 4: ("", None)}
    passage = "One two three four five. Six seven eight nine ten eleven.\nTwelve thirteen fourteen! Is it fifteen sixteen seventeen eighteen nineteen?"
    texts = [(1, f"It begins {passage} It ends."), (2, f"Elsewhere it begins so. {passage} And goes on. It ends."), (3, "One two three four five. It ends."), (4, f"Six seven. {passage}")]
    out = {r.doc_id: r.text for r in units.judge(docs_of(spark, texts), unit="sentence", run_words=12).collect()}
    assert out == {1: texts[0][1], 2: "Elsewhere it begins so. One two three four five. And goes on. It ends.", 3: texts[2][1], 4: "Six seven."}


def test_quality_base_and_verdict(spark, prose):
    junk = [(400 + i, " ".join(f"w{j}x%%%" for j in range(40 + i))) for i in range(6)] + [(410 + i, " ".join("same" if j % 2 else "same" for j in range(30))) for i in range(3)]
    texts = prose + junk
    labels = spark.createDataFrame([(i, 0 if i >= 400 else 1, 0) for i, _ in texts if i < 100 or i >= 400], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.judge(docs_of(spark, texts), labels).collect()}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)), i
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and (not r.base_failed or not r.kept)
    assert not any(out[i].kept for i, _ in junk) and all(out[i].kept for i, _ in texts if i < 300 and not out[i].base_failed)
    kept = quality.keep(docs_of(spark, texts), labels)
    assert kept.columns == ["doc_id", "text", "n_words", "_key"] and {r.doc_id for r in kept.collect()} == {i for i, r in out.items() if r.kept}
    twice = labels.unionByName(labels).unionByName(labels.filter("doc_id = 1").selectExpr("doc_id", "cast(null as int) quality", "toxic"))
    assert {r.doc_id: r.kept for r in quality.judge(docs_of(spark, texts), twice.withColumnRenamed("doc_id", "of"), label_key="of").collect()} == {i: r.kept for i, r in out.items()}
    none = labels.limit(0)
    assert quality.judge(docs_of(spark, texts), none).filter("not kept and not base_failed").count() == 0 and quality.judge(docs_of(spark, []), labels).count() == 0 and quality.keep(docs_of(spark, []), labels).count() == 0


@pytest.mark.parametrize("shard", [decontaminate.SHARD, 40])
def test_decontamination(spark, prose, shard):
    bench = [(1, prose[30][1].split("\n")[1]), (2, "The, an! er"), (3, None), (4, ""), (5, prose[30][1].split("\n")[1][:200]), (1, "zz")]
    texts = [*prose, (500, "x the AN er y"), (501, "the an er"), (502, "thé an er")]
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    grams = {}
    for i, t in bench:
        w = norm(t)
        for k in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    b = spark.createDataFrame([(*x, "w") for x in bench], "item_id long, text string, window string")
    out = decontaminate.judge(docs_of(spark, texts), b, shard=shard).collect()
    assert len(out) == len(texts)
    want = {}
    for i, t in texts:
        w = norm(t)
        hits = [(k, n, g) for n in {len(g) for g in grams} for k in range(len(w) - n + 1) if (g := tuple(w[k : k + n])) in grams]
        covered, items = {k + j for k, n, _ in hits for j in range(n)}, sorted({x for *_, g in hits for x in grams[g]})
        want[i] = (len(w), len(covered), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), bool(covered) and 20 * len(covered) >= len(w))
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out} == want
    clean = decontaminate.clean(docs_of(spark, texts), b, shard=shard)
    assert clean.columns == ["doc_id", "text", "n_words", "_key"] and sorted(r.doc_id for r in clean.collect()) == sorted(i for i, _ in texts if not want[i][4])
    if shard > 40:
        assert decontaminate.judge(docs_of(spark, texts), b.limit(0)).filter("n_hit > 0").count() == 0 and decontaminate.judge(docs_of(spark, []), b).count() == 0
        cut = {r.doc_id: r.text for r in decontaminate.without_spans(docs_of(spark, texts), b).collect()}
        assert cut[500] == "x y" and cut[501] == "" and cut[502] == "thé an er"


def test_decontamination_of_a_large_benchmark(spark):
    rng = random.Random(12)
    item = [f"{rng.randrange(1 << 40):x}" for _ in range(decontaminate.SHARD + 5_000)]
    b = spark.createDataFrame([(1, " ".join(item)), (2, "one two three")], "item_id long, text string")
    texts = [(i, " ".join(["plain"] * i + item[5_000 * i : 5_000 * i + 13 + i])) for i in range(11)] + [(20, " ".join(item[:12])), (21, "x one two three y"), (22, None), (22, None)]
    out = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.judge(docs_of(spark, texts), b).collect()]
    assert sorted(out) == [(i, 13 + 2 * i, 13 + i, 1, True) for i in range(11)] + [(20, 12, 0, 0, False), (21, 5, 3, 1, True), (22, 0, 0, 0, False), (22, 0, 0, 0, False)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs_of(spark, texts), b).collect()) == [20, 22, 22]


def test_quality_verdict_holds_for_unseen_labels(spark):
    """Every other labelled document is kept out of the fit: junk of three kinds goes, sound prose stays."""
    rng = random.Random(21)
    words = ["".join(rng.choice(["th", "an", "er", "on", "re", "ti", "es"]) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [(i, " ".join(say(rng.randint(25, 300)))) for i in range(600)]
    texts += [(1000 + i, " ".join(w + rng.choice(["%%%", "&&", "#"]) for w in say(60))) for i in range(40)]
    texts += [(2000 + i, " | ".join(say(50))) for i in range(40)] + [(3000 + i, " ".join(w for w in say(12) for _ in range(rng.randint(3, 6)))) for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in texts if i % 2], "doc_id long, quality int, toxic int")
    out = [r for r in quality.judge(docs_of(spark, texts), labels).collect() if r.doc_id % 2 == 0]
    assert sum(r.kept for r in out if r.doc_id < 1000) >= 0.98 * 300 and sum(not r.kept for r in out if r.doc_id >= 1000) >= 0.95 * 60


def test_forest_and_threshold_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, len(quality.FEATURES)))
    forest = quality.grow(x, trees=20, rows=64)

    def path(t, row):
        at, edges = 0, 0
        while forest.feature[t, at] >= 0:
            at = forest.child[t, at] + (row[forest.feature[t, at]] >= forest.value[t, at])
            edges += 1
        leaf = forest.depth[t, at]
        assert leaf >= edges and (leaf == edges or edges == forest.levels or leaf - edges <= quality.expected_path(64))
        return leaf

    want = [2 ** (-np.mean([path(t, row) for t in range(20)]) / quality.expected_path(64)) for row in x[:60]]
    assert np.allclose(forest.scores(x[:60]), want)
    harmonic = lambda n: sum(1 / i for i in range(1, n + 1))
    assert abs(quality.expected_path(64) - (2 * harmonic(63) - 2 * 63 / 64)) < 0.02
    scores, good = rng.random(2000).round(3) * 0.5, rng.random(2000) < 0.8
    scores[~good] += rng.random((~good).sum()) * 0.5
    rows = [(i, 100, 0, float(s)) for i, s in enumerate(scores)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_repeat_words long, score double")
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    cut = quality.threshold_of(scored, labels)
    lost = lambda c: (scores[good] >= c).mean()
    caught = lambda c: (scores[~good] >= c).mean()
    steps = np.arange(quality.SCORE_STEPS + 1) / quality.SCORE_STEPS
    best = max(caught(c) - lost(c) for c in steps if lost(c) <= quality.MAX_GOOD_DROPPED)
    assert lost(cut) <= quality.MAX_GOOD_DROPPED and caught(cut) - lost(cut) >= best - 1e-9


def test_simhash_components(spark, prose):
    rng = random.Random(3)
    base = prose[9][1].split() * 6
    near = []
    for i in range(40):
        w = list(base)
        w[rng.randrange(len(w))] = "zq"
        near.append((600 + i, " ".join(w)))
    texts = prose + near

    def fp(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        g = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [(i, fp(t)) for i, t in texts]
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    n_links = 0
    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                n_links += 1
                root[find(a)] = find(b)
    assert n_links > 0
    least = {}
    for i, f in fps:
        least[find(f)] = min(i, least.get(find(f), i))
    out = simhash.judge(docs_of(spark, texts)).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == sorted((i, f"{f:016x}", least[find(f)]) for i, f in fps)
    first = simhash.first_of_group(docs_of(spark, texts))
    assert first.columns == ["doc_id", "text", "n_words", "_key"] and sorted(r.doc_id for r in first.collect()) == sorted(set(least.values()))
    assert simhash.judge(docs_of(spark, [])).count() == 0


def test_simhash_keeps_one_row_of_each_group(spark, prose):
    a, b, c, d, e = [t for _, t in prose[:30] if len(t.split()) > 20][:5]
    # a: null ids only; b: alone with a null id; c: a copy under an id that another group has; d and e: two texts of one id
    texts = [(None, a), (None, a), (None, b), (1, c), (2, c), (2, d), (2, e), (2, e), (None, e)]
    for seed in range(2):
        rows = random.Random(seed).sample(texts, len(texts))
        first = simhash.first_of_group(docs_of(spark, rows))
        assert sorted((r.doc_id or 0, r.text) for r in first.collect()) == sorted([(0, a), (0, b), (1, c), (2, d), (2, e)])
    assert simhash.first_of_group(docs_of(spark, [])).count() == 0


def test_suffix_dedup(spark, prose):
    texts = [*prose, (700, "q" * 1200), (701, "start " + prose[40][1]), (702, prose[36][1] + " end")]
    line = "it rains on the old harbour wall and on the boats that lie there until the wind turns round once more; "
    texts += [(703, "ab" * 700), (704, "one " + "ab" * 230 + " two"), (705, "x" * 30 + "q" * 400), (706, line * 12), (707, line[50:] + line * 4), (708, "z" * 401), (709, "y" * 400), (710, "abc" * 500 + "ab" * 205), (711, "end " + line * 3 + line[:95])]
    data = [(i, (t or "").encode()) for i, t in texts]
    counts = Counter(b[k : k + 400] for _, b in data for k in range(len(b) - 399))
    want = []
    for i, b in data:
        cov = bytearray(len(b))
        for k in range(len(b) - 399):
            if counts[b[k : k + 400]] > 1:
                cov[k : k + 400] = b"\1" * 400
        runs = sum(1 for k in range(len(b)) if cov[k] and not (k and cov[k - 1]))
        want.append((i, len(b), sum(cov), runs, hashlib.sha256(bytes(x for x, c in zip(b, cov) if not c)).hexdigest()))
    out = suffixes.judge(docs_of(spark, texts), batches=3).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == sorted(want)
    assert sum(w[2] > 0 for w in want) > 10 and suffixes.judge(docs_of(spark, []), batches=2).count() == 0


def test_suffixes_of_a_text_that_repeats_itself():
    """A stretch of equal strings has one suffix, which covers it all."""
    for unit in (b"a", b"ab", b"a line of sixty letters or so that someone copied many times\n"):
        data = (unit * 1_000_000)[:1_000_000]
        own = suffixes.suffixes_of(data)
        assert len(own) < 20 and own[0][0] == 0 and own[-1][-1] == len(data) - 400
        assert all(a[-1] + 1 == b[0] for a, b in zip(own, own[1:]))
    noise = random.Random(3).randbytes(300_000)
    assert all(s[-1] == s[1] for s in suffixes.suffixes_of(noise)) and len(suffixes.suffixes_of(noise)) < 6_000


def test_family_merges_geometrically_and_outlives_the_session(spark, tmp_path):
    batches = [spark.createDataFrame([(k, k, k, k, 1), (99, 99, b, b, 1), (7, b, 1, 1, 2)], suffixes.RUN) for b, k in enumerate(range(100, 107))]
    met, levels = [], []
    for rows in batches:  # each batch meets what earlier ones left on disk
        family = suffixes.Family(spark, str(tmp_path), 4)
        found = family.add(rows)
        met.append({(r.head, r.print) for r in family.read(found).collect()})
        levels.append(sorted(family.levels))
        family.close()
    assert levels == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2]]
    assert met == [{(7, b)} | ({(99, 99)} if b else set()) for b in range(7)]  # (7, b) occurs twice within its batch
    family = suffixes.Family(spark, str(tmp_path))
    rows = family.all_levels().collect()
    assert family.buckets == 4 and sum(r.n for r in rows) == 28 and len(rows) == 21
    run = next(iter(family.levels.values()))
    with suffixes.in_order(spark):
        plan = family.read(run).select(*suffixes.KEY).hint("merge").join(family.read(list(family.levels.values())[1]).select(*suffixes.KEY), suffixes.KEY, "left_semi")
        text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "SortMergeJoin" in text
    family.close(keep=False)
