"""LM scoring: the likelihood of a text over its subword lattice, beside a word-count base.

The model: a text is a sequence of words and one end; a word's probability is the sum over all
segmentations of the marked word (forward recursion in log space), with piece probabilities that
start at the existing vocabulary's weights and get one round of expectation over all training words.

Word counts cover all rows and stay distributed; each distinct word goes through the lattice once. The
``HEAD`` most frequent words (a fixed number, sent to every task) are looked up inside the scoring pass; a
text's other words travel as small rows, one for each text and word, and are joined with the words'
table. Texts are never shuffled.

Defined cases: null is the empty text, whose only token is the end; a key that is null counts as
empty text in the fold; repeated rows are scored each; with no training rows N and V are 0, the
base is log10(1/1) = 0 a token, and the model keeps the vocabulary's own weights.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log, log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C
from valuegrain.llm import lattice as L

FOLDS, HELD = 7, 2
#: Words whose counts every task holds.
HEAD = 150_000
#: Uses that are added to the pieces' expected ones, spread by the vocabulary's own weights.
PRIOR = 10_000.0
#: Words that a counting task gathers before it emits them.
FLUSH = 300_000


def held_out(key: str) -> F.Column:
    return C.crc_mod(key, FOLDS) == HELD


def as_word(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def as_marked(word: str) -> str:
    return L.MARK + word.replace(L.MARK, L.OWN_MARK)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all words of (text, trains): how often training rows have each; counted in each task before the shuffle."""

    def emit(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(map(as_word, counts)), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, trains in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = C.utf8_lower(text).split()
                if trains:
                    counts.update(words)
                else:
                    for w in words:
                        counts.setdefault(w, 0)
                if len(counts) > FLUSH:
                    yield emit(counts)
                    counts.clear()
        if counts:
            yield emit(counts)

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_uses(counts: DataFrame, voc: L.Vocabulary) -> dict[int, float]:
    """Expected uses of each piece over all counted words; a row for each piece reaches the driver."""
    shared = counts.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tilt = L.tilted({p: (x,) for p, x in own.log_weight.items()})
        for batch in batches:
            parts: Counter = Counter()
            for word, c in zip(*[x.to_pylist() for x in batch.columns]):
                for part in L.segments(as_marked(word), own.pairs):
                    parts[part] += c
            uses = L.expected(parts.items(), own, tilt)
            yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.int32()), pa.array(list(uses.values()), pa.float64())], names=["piece", "n"])

    rows = counts.filter("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


def probabilities(voc: L.Vocabulary, uses: dict[int, float]) -> tuple[dict[str, float], float]:
    """Log probabilities of the pieces and of a byte."""
    total = sum(uses.values()) + PRIOR
    weight = {p: log((uses.get(i, 0.0) + PRIOR * exp(voc.log_weight[p])) / total) for p, i in voc.ids.items()}
    byte_uses = sum(uses.get(i, 0.0) for i in voc.byte_ids) / len(voc.byte_ids)
    return weight, log((byte_uses + PRIOR * exp(voc.byte_log_weight)) / total)


def with_lattice(counts: DataFrame, pairs: frozenset[str], weight: dict[str, float], byte_weight: float) -> DataFrame:
    """Add ``p``, the natural log of each word's probability: every distinct word of the corpus goes through the lattice once."""
    shared = counts.sparkSession.sparkContext.broadcast((pairs, weight, byte_weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_pairs, table, for_byte = shared.value
        table = L.with_suffixes(table, 1.0)
        for batch in batches:
            cut = [L.segments(as_marked(w), known_pairs) for w in batch.column(0).to_pylist()]
            parts = L.log_sum(list({x for own in cut for x in own}), table, for_byte)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sum([parts[x] for x in own]) for own in cut], pa.float64())], names=["word", "c", "p"])

    return counts.select("word", "c").mapInArrow(run, "word string, c long, p double")


def judge(docs: DataFrame, key: str = "doc_id", text_col: str = "text", model: str = L.MODEL) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row."""
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    counts = C.stage(word_counts(own.select("text", (~held_out("key")).alias("trains"))), "words")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = own.filter(~held_out("key")).select("key").count()
    n, v = totals["n"] + ends, totals["v"] + bool(ends)
    base = log10(n + v + 1)
    voc = L.load(model)
    words = C.stage(with_lattice(counts, voc.pairs, *probabilities(voc, piece_uses(counts, voc))), "lattice")
    C.drop_stage(counts)
    end_share = (ends + 1) / (n + 2)
    head = {r["word"].encode(): (int(r["c"] > 0), log10(r["c"] + 1) - base, r["p"]) for r in words.orderBy(F.desc("c"), "word").limit(HEAD).toLocalIterator()}
    shared = spark.sparkContext.broadcast(head)

    def make():
        get = shared.value.get
        for_end, for_word, for_stop = log10(ends + 1) - base, log(1 - end_share), log(end_share)

        def work(texts):
            rows, tail_words, tail_counts, offsets = [], [], [], [0]
            for t in texts:
                split = C.utf8_lower(t).split()
                known, low, p = int(bool(ends)), for_end, for_stop + len(split) * for_word
                for w, k in Counter(split).items():
                    v = get(w)
                    if v is None:
                        tail_words.append(as_word(w))
                        tail_counts.append(k)
                    else:
                        known += k * v[0]
                        low += k * v[1]
                        p += k * v[2]
                offsets.append(len(tail_words))
                rows.append((len(split) + 1, known, low, p))
            items = pa.StructArray.from_arrays([pa.array(tail_words, pa.string()), pa.array(tail_counts, pa.int64())], names=["word", "k"])
            return [*[list(x) for x in zip(*rows)], pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)]

        return work

    item = T.StructType([T.StructField("word", T.StringType()), T.StructField("k", T.LongType())])
    fields = [("n_tokens", T.LongType()), ("head_known", T.LongType()), ("head_base", T.DoubleType()), ("head_p", T.DoubleType()), ("tail", T.ArrayType(item))]
    passed = C.map_texts(own, "text", fields, make, carry=["key"])
    passed = C.stage(passed.select(*C.unpack(passed, "key"), *[f for f, _ in fields]).withColumn("row", F.monotonically_increasing_id()), "scored")
    tails = passed.select("row", F.explode("tail").alias("t")).select("row", F.col("t.word").alias("word"), F.col("t.k").alias("k"))
    joined = tails.join(words, "word", "left")
    value = F.log10(F.col("c") + F.lit(1)) - F.lit(base)
    sums = joined.groupBy(F.col("row").alias("of")).agg(
        F.sum(F.col("k") * value).alias("tail_base"), F.sum(F.col("k") * F.col("p")).alias("tail_p"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tail_known")
    )
    done = passed.drop("tail").join(sums, F.col("row") == F.col("of"), "left")
    zero = F.lit(0.0)
    return done.select(
        F.col("key").alias(key), held_out("key").alias("held_out"), "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("head_base") + F.coalesce("tail_base", zero)).alias("base_score"),
        ((F.col("head_p") + F.coalesce("tail_p", zero)) / F.lit(log(10))).alias("score"),
    )
