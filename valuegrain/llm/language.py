"""Language identification by segmentation-marginalised unigrams.

Each language has piece probabilities over a fixed public vocabulary. A word's probability is the
sum over all its segmentations (forward algorithm), a text's the product over its words; the
language with the highest probability wins.

Training uses a bounded sample of labelled rows (``SAMPLE`` a language, chosen by a hash of the
key) and one round of expectation over all their words, both as Spark jobs. Every language that
has a training row is learned. Scoring is narrow, one step over the texts for each ``BLOCK``
languages, whose piece tables are what reaches the driver and the tasks at once; distinct words of
some texts are scored once, all together.

Defined cases: null text or text without a letter is ``und`` with score 0; without any training
row every text is ``und``; a null language is not learned; ties go to the smaller language name;
texts are scored whole, whatever their length; repeated rows get equal predictions; an empty table
gives an empty result; key, language and source never enter a prediction.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C
from valuegrain.llm import lattice as L

FOLDS = 5
#: Labelled rows learned from, for each language, at most about so many.
SAMPLE = 3_000
#: Languages whose piece tables a task holds at once.
BLOCK = 48
#: Uses of each piece that are added to what was seen, spread by the vocabulary's own weights.
PRIOR = 2_000.0
UNKNOWN = "und"


def held_out(key: str) -> F.Column:
    return C.crc_mod(key, FOLDS) == 0


def sample_of(docs: DataFrame, key: str, text_col: str, lang_col: str, rows: int = SAMPLE) -> DataFrame:
    """(lang, text) of at most about ``rows`` training rows for each language."""
    train = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(key).alias("key")).filter(~held_out("key") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = C.stage(train.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("n")), "languages")
    place = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30))
    share = F.floor(F.least(F.lit(1.0), F.lit(rows) / F.col("n")) * (1 << 30)) + 1
    return train.join(sizes, F.col("lang") == F.col("_lang")).filter(place < share).select("lang", "text")


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) of marked words; counted inside each batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update([(lang, w) for w in text.split()])
            langs, words = ([k[0] for k in counts], L.marked(k[1] for k in counts))
            words = [w.replace(L.OWN_MARK, "�") for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])

    return sample.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_uses(counts: DataFrame, voc: L.Vocabulary) -> DataFrame:
    """(lang, piece, n): expected uses of the pieces under the vocabulary's weights."""
    shared = counts.sparkSession.sparkContext.broadcast(voc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tilt = L.tilted({p: (x,) for p, x in own.log_weight.items()})
        for batch in batches:
            by_lang: dict[str, Counter] = {}
            for lang, word, n in zip(*[c.to_pylist() for c in batch.columns]):
                into = by_lang.setdefault(lang, Counter())
                for part in L.segments(word, own.pairs):
                    into[part] += n
            rows = [(lang, piece, n) for lang, words in by_lang.items() for piece, n in L.expected(words.items(), own, tilt).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.float64()))], names=["lang", "piece", "n"])

    return counts.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: str = L.MODEL, rows: int = SAMPLE) -> tuple[L.Vocabulary, DataFrame, list[str]]:
    """Vocabulary, expected uses (lang, piece, n) as a staged table, and all languages in order."""
    voc = L.load(model)
    uses = C.stage(expected_uses(word_counts(sample_of(docs, key, text_col, lang_col, rows)), voc), "uses")
    return voc, uses, sorted(r["lang"] for r in uses.select("lang").distinct().collect())


def tables(uses: DataFrame, voc: L.Vocabulary, langs: list[str]) -> tuple[dict[str, tuple[float, ...]], tuple[float, ...]]:
    """Log probabilities of each piece by language, and of a byte by language."""
    rows = uses.filter(F.col("lang").isin(langs)).toPandas()
    byte_weight = exp(voc.byte_log_weight)
    by_lang, unknown = [], []
    for lang in langs:
        own = rows[rows["lang"] == lang]
        seen = dict(zip(own["piece"], own["n"]))
        total = sum(seen.values()) + PRIOR
        by_lang.append({p: log((seen.get(i, 0.0) + PRIOR * exp(voc.log_weight[p])) / total) for p, i in voc.ids.items()})
        unknown.append(log((sum(seen.get(i, 0.0) for i in voc.byte_ids) / len(voc.byte_ids) + PRIOR * byte_weight) / total))
    return {p: tuple(t[p] for t in by_lang) for p in voc.ids}, tuple(unknown)


def with_block(texts: DataFrame, carry: list[str], voc: L.Vocabulary, langs: list[str], weight: dict[str, tuple[float, ...]], unknown: tuple[float, ...]) -> DataFrame:
    """(_key, _text, lang_pred, high, mass) once more, these languages compared too: the best one so far, its log probability, all probabilities over its."""
    shared = texts.sparkSession.sparkContext.broadcast((langs, voc.pairs, weight, unknown))

    def make():
        names, pairs, table, bytes_too = shared.value
        memory = L.Rows(L.Sums(table, L.tilted(table), bytes_too), pairs)

        def totals_of(counted: list[Counter]) -> list[list[float]]:
            """Log probabilities of each text, by language."""
            places = {w: i for i, w in enumerate({w for c in counted for w in c})}
            logs = memory.of(list(places))
            sizes = np.array([len(c) for c in counted])
            at = np.fromiter((places[w] for c in counted for w in c), np.int64, sizes.sum())
            n = np.fromiter((n for c in counted for n in c.values()), np.float64, len(at))
            return np.add.reduceat(logs[at] * n[:, None], np.cumsum(sizes) - sizes, axis=0).tolist()

        def verdict(totals: list[float], best: str | None, before: float | None, mass: float | None) -> tuple[str, float, float]:
            top = max(totals)
            if best is not None and before >= top:
                return best, before, mass + sum(exp(t - before) for t in totals)
            return names[totals.index(top)], top, sum(exp(t - top) for t in totals) + (mass * exp(before - top) if best is not None else 0.0)

        def work(texts, best, high, mass):
            out = [(None, None, None)] * len(texts)
            for a, b in L.chunks(texts):
                counted = [Counter((" " + t).replace(L.MARK, L.OWN_MARK).split()) if t else Counter() for t in texts[a:b]]
                own = [i for i, c in enumerate(counted) if any(map(str.isalpha, c)) or any(any(map(str.isalpha, w)) for w in c)]
                if own:
                    totals = totals_of([Counter({L.MARK + w: n for w, n in counted[i].items()}) for i in own])
                    for i, found in zip(own, totals, strict=True):
                        out[a + i] = verdict(found, best[a + i], high[a + i], mass[a + i])
            return [list(x) for x in zip(*out)]

        return work

    fields = [("lang_pred", T.StringType()), ("high", T.DoubleType()), ("mass", T.DoubleType())]
    out = C.map_texts(texts, "_text", fields, make, carry=carry, also=[n for n, _ in fields])
    return out.select(*C.unpack(out, *carry), *[n for n, _ in fields])


def judge(docs: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: str = L.MODEL, rows: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(key, held_out, lang_pred, score) for each row; score is the share of the winner's posterior."""
    voc, uses, langs = train(docs, key, text_col, lang_col, model, rows)
    done = docs.select(
        F.col(key).alias("_key"), F.col(text_col).alias("_text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("mass")
    )
    for at in range(0, len(langs), block):
        carry = ["_key", "_text"] if at + block < len(langs) else ["_key"]
        done = with_block(done, carry, voc, langs[at : at + block], *tables(uses, voc, langs[at : at + block]))
    return done.select(F.col("_key").alias(key), held_out("_key").alias("held_out"), F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(F.lit(1.0) / F.col("mass"), F.lit(0.0)).alias("score"))
