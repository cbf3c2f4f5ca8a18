"""Quality rules: an isolation forest on rule statistics.

One pass over the whole texts gives each document's rule statistics (a small table, staged). The
forest is grown on a bounded sample of those rows, as the method prescribes (each tree sees
``TREE_ROWS`` rows), its threshold comes from all labelled rows, and the verdict is a second
pass over the small table. Texts are never shuffled.

Defined cases: a null or blank text has no words, fails the base rule and is dropped; statistics
of a text depend on it alone, so repeated rows and ties get equal verdicts; without labelled rows
of both kinds nothing but the base rule drops a document; a document that is labelled more than once
counts once, as good only if every label says so; null labels and labels of unknown documents count
for nothing; an empty table gives an empty result; columns other than key and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
#: What makes a word more than punctuation.
BARE = re.compile(rb"[0-9A-Za-z\x80-\xff]")
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Trees of the forest, rows that a tree sees, and so the bound of the sample that goes to the driver.
TREES, TREE_ROWS = 128, 256
SAMPLE_ROWS = TREES * TREE_ROWS
#: Share of good labelled documents that the threshold may drop at most.
MAX_GOOD_DROPPED = 0.002
SCORE_STEPS = 10_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the forest sees, all unrounded: mean word length; shares of repeated lines, of words in repeated windows, of symbols among
#: word characters, of words with a symbol, of words equal to the one before, of ASCII words without a letter or digit, of distinct words.
FEATURES = ("f_length", "f_lines", "f_repeat", "f_symbols", "f_marked", "f_same", "f_bare", "f_distinct")


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; exact, by doubling ranks after a cheap hash test."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    s = np.sort(h)
    if not (s[1:] == s[:-1]).any():
        return 0
    rank, span = ids.astype(np.int64), 1
    while span < window:
        step = min(span, window - span)
        pairs = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        rank, span = np.unique(pairs, return_inverse=True)[1], span + step
    starts = np.flatnonzero(np.bincount(rank)[rank] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple:
    """The base counts and the features of one text."""
    data = C.utf8(text)
    words = data.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(data.count, map(bytes, zip(SYMBOLS)))), 0, 0, *[0.0] * len(FEATURES))
    chars = len(text) - sum(data.count(b) for b in BLANKS)
    symbols = sum(data.count(b) for b in SYMBOLS)
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    counts = np.bincount(ids)
    repeat = repeated_words(ids)
    same = int((ids[1:] == ids[:-1]).sum())
    bare = int(counts[[i for w, i in seen.items() if not BARE.search(w)]].sum())
    marked = int(counts[[i for w, i in seen.items() if w.translate(None, SYMBOLS) != w]].sum()) if symbols else 0
    return (n, chars, symbols, dup, repeat, chars / n, dup / len(lines), repeat / n, symbols / chars, marked / n, same / n, bare / n, len(seen) / n)


def with_statistics(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key, base counts and features; one narrow pass over the texts."""
    fields = [(n, T.LongType()) for n in BASE] + [(n, T.DoubleType()) for n in FEATURES]

    def make():
        def work(texts):
            rows = [statistics(t) for t in texts]
            return [list(c) for c in zip(*rows)]

        return work

    out = C.map_texts(docs, text_col, fields, make, carry=[key])
    return out.select(*C.unpack(out, key), *BASE, *FEATURES)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))


@dataclass(frozen=True)
class Forest:
    """Trees as flat arrays: split feature (-1 at a leaf), split value, first child, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    norm: float
    levels: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / its expectation): near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.levels):
                f = self.feature[t, at]
                inner = f >= 0
                right = x[rows, np.maximum(f, 0)] >= self.value[t, at]
                at = np.where(inner, self.child[t, at] + right, at)
            total += self.depth[t, at]
        return np.exp2(-total / (len(self.feature) * self.norm))


def expected_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """An isolation forest on random splits of random subsamples."""
    rng = np.random.default_rng(seed)
    rows = min(rows, len(sample))
    levels = max(1, int(np.ceil(np.log2(max(2, rows)))))
    size = 2 ** (levels + 1)
    feature, value = np.full((trees, size), -1), np.zeros((trees, size))
    child, depth = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        used = 1
        todo = [(0, sample[rng.permutation(len(sample))[:rows]], 0)]
        while todo:
            at, own, d = todo.pop()
            spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else ()
            if d == levels or not len(spread):
                depth[t, at] = d + expected_path(len(own))
                continue
            f = int(rng.choice(spread))
            low, high = own[:, f].min(), own[:, f].max()
            cut = low + (high - low) * (1 - rng.random())
            feature[t, at], value[t, at], child[t, at] = f, cut, used
            side = own[:, f] >= cut
            todo += [(used, own[~side], d + 1), (used + 1, own[side], d + 1)]
            used += 2
    return Forest(feature, value, child, depth, expected_path(rows) or 1.0, levels)


def with_score(stats: DataFrame, forest: Forest, name: str = "score") -> DataFrame:
    """Add the forest's anomaly score; the forest has a fixed size whatever the input."""
    shared = stats.sparkSession.sparkContext.broadcast(forest)
    schema = T.StructType([*stats.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x), pa.float64())], names=[*batch.schema.names, name])

    return stats.mapInArrow(run, schema)


def sample_of(stats: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id") -> np.ndarray:
    """At most about ``rows`` rows, chosen by a hash of the key; the bound holds for any input size."""
    n = stats.count()
    share = min(1.0, rows / max(1, n))
    chosen = stats.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)).orderBy(F.xxhash64(F.col(key)), *FEATURES)
    return chosen.select(*FEATURES).limit(rows).toPandas().to_numpy(float)


def threshold_of(scored: DataFrame, labels: DataFrame, key: str = "doc_id", label_key: str = "doc_id") -> float:
    """From a histogram over all labelled rows (fixed size): the cut with the most bad documents caught at few good ones lost."""
    own = labels.filter("quality is not null").groupBy(F.col(label_key).alias("_label_of")).agg(F.min("quality").alias("quality"))
    joined = scored.filter(~base_failed()).join(own, F.col(key) == F.col("_label_of"))
    step = F.floor(F.col("score") * SCORE_STEPS).alias("step")
    hist: pd.DataFrame = joined.groupBy(step).agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") != 0).alias("good")).toPandas()
    if not len(hist) or not hist["bad"].sum() or not hist["good"].sum():
        return 2.0
    hist = hist.sort_values("step", ascending=False)
    bad, good = hist["bad"].cumsum() / hist["bad"].sum(), hist["good"].cumsum() / hist["good"].sum()
    allowed = good <= MAX_GOOD_DROPPED
    if not allowed.any():
        return 2.0
    best = (bad - good)[allowed].idxmax()
    below = hist[hist["step"] < hist.loc[best, "step"]]["step"]
    cut = int(hist.loc[best, "step"])
    return (cut + (int(below.iloc[0]) + 1 if len(below) else cut)) / 2 / SCORE_STEPS  # midway to the next score seen


def verdict(docs: DataFrame, labels: DataFrame, key: str, text_col: str, label_key: str) -> tuple[DataFrame, Forest | None, float]:
    """The staged statistics, the forest and the threshold."""
    stats = C.stage(with_statistics(docs, key, text_col), "quality")
    sample = sample_of(stats, key=key)
    if not len(sample):
        return stats, None, 2.0
    forest = grow(sample)
    return stats, forest, threshold_of(with_score(stats, forest), labels, key, label_key)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_key: str = "doc_id") -> DataFrame:
    """Key, base counts, base_failed, score, kept: one row for each row of ``docs``."""
    stats, forest, cut = verdict(docs, labels, key, text_col, label_key)
    failed = base_failed()
    if forest is None:
        return stats.select(key, *BASE, failed.alias("base_failed"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    return with_score(stats, forest).select(key, *BASE, failed.alias("base_failed"), "score", (~failed & (F.col("score") < cut)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns; judged row by row in one more narrow pass, so texts aren't shuffled."""
    _, forest, cut = verdict(docs, labels, key, text_col, label_key)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        def work(texts):
            rows = [statistics(t) for t in texts]
            if shared.value is None:
                return [[False] * len(rows)]
            scores = shared.value.scores(np.array([r[len(BASE) :] for r in rows]))
            return [[bool(r[0] >= MIN_WORDS and 100 * r[4] <= MAX_REPEAT_PERCENT * r[0] and s < cut) for r, s in zip(rows, scores)]]

        return work

    out = C.map_texts(docs, text_col, [("_kept", T.BooleanType())], make)
    return out.filter("_kept").select(f"{C.CARRIED}.*")
