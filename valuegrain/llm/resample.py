"""Target-distribution importance resampling over hashed word n-grams.

One table of 256 bytes lower-cases A-Z and blanks separators, so a text's words are a translate and a split of its UTF-8
bytes. An n-gram's crc32 goes on from the crc32 of the one a word shorter. Buckets are counted in every task and summed;
their number bounds what reaches the driver and what is sent to the tasks. A second pass weighs each document by its
features' gains; Gumbel noise from the document's id makes the highest scores a sample without replacement.
The ranks are places in a sort by range.

Defined cases: null and wordless texts have no features and weigh 0; a null id counts as the empty one and comes last among
equal scores; repeated rows are drawn each, in any order; an empty target leaves each bucket's gain to the corpus; an empty
table gives an empty result; texts are read whole; other columns than id and text aren't read by ``judge`` and are kept by ``draw``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C
from valuegrain.llm.order import numbered

#: Words of a feature at most, buckets, words a drawn document has at least, drawn per cent, seed of the noise.
MAX_WORDS, BUCKETS, LEAST_WORDS, PER_CENT, SEED = 1, 10_000, 20, 10, 2024
#: Bytes as they are, but A-Z as a-z and what is no ASCII letter or digit as a blank.
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(C.UPPER.encode(), C.LOWER.encode()))


def buckets_of(text: str | None, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> tuple[int, Counter]:
    """(words, count of each bucket) of a text."""
    words = C.utf8(text).translate(TABLE).split()
    grams = [crc32(w) for w in words]
    found = Counter(g % buckets for g in grams)
    for n in range(1, max_words):
        grams = [crc32(b" " + w, g) for g, w in zip(grams, words[n:])]
        found.update(g % buckets for g in grams)
    return len(words), found


def bucket_counts(texts: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; each task sends its own counts, at most one for a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(buckets_of(text, max_words, buckets)[1])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    return texts.select(F.col(f"`{text_col}`")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> list[int]:
    """Each bucket's gain in thousandths: the log ratio of its smoothed share of the target's features to that of the corpus's."""
    corpus = bucket_counts(docs, text_col, max_words, buckets).select(F.col("bucket").alias("_b"), F.col("n").alias("s"))
    wanted = bucket_counts(target, text_col, max_words, buckets).select(F.col("bucket").alias("_t"), F.col("n").alias("t"))
    counts = C.stage(corpus.join(wanted, F.col("_b") == F.col("_t"), "full").select(F.coalesce("_b", "_t").alias("bucket"), F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    every = docs.sparkSession.range(buckets).join(counts, F.col("id") == F.col("bucket"), "left")
    part = lambda c, other: (F.coalesce(F.col(c), F.lit(0)) + 1).cast("double") * F.lit(float(other + buckets))
    gain = F.floor(F.log(part("t", total["s"]) / part("s", total["t"])) * 1000).alias("gain")
    out = [0] * buckets
    for r in every.select("id", gain).collect():
        out[r["id"]] = r["gain"]
    return out


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000)


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Carried columns with n_words, n_features, weight and score."""
    own = docs.sparkSession.sparkContext.broadcast(gains(docs, target, text_col, max_words, buckets))

    def make():
        gain = own.value

        def work(texts):
            out = [], [], []
            for t in texts:
                n, found = buckets_of(t, max_words, buckets)
                for column, x in zip(out, (n, sum(found.values()), sum(gain[b] * k for b, k in found.items())), strict=True):
                    column.append(x)
            return list(out)

        return work

    found = C.map_texts(docs, text_col, [("n_words", T.LongType()), ("n_features", T.LongType()), ("weight", T.LongType())], make)
    return found.withColumn("score", F.col("weight") + noise(F.col(f"{C.CARRIED}.`{key}`"), seed))


def ranked(rows: DataFrame, key: str, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT) -> DataFrame:
    """All staged rows (_key, n_words, score, ...) with ``rank`` from 1 for those drawn, null for the rest."""
    able = F.col("n_words") >= least_words
    placed = numbered(rows.filter(able), [F.col("score").desc(), F.col(key).asc_nulls_last()])
    drawn = rows.filter(able).count() * per_cent // 100
    return placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place").unionByName(rows.filter(~able).withColumn("rank", F.lit(None).cast("long")))


def judge(docs: DataFrame, target: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank) for each row."""
    found = scored(docs.select(key, text_col), target, key, text_col)
    rows = C.stage(found.select(F.col(f"{C.CARRIED}.`{key}`").alias("_key"), "n_words", "n_features", "weight", "score"), "scored")
    return ranked(rows, "_key").select(F.col("_key").alias(key), "n_features", "weight", "score", "rank")


def draw(docs: DataFrame, target: DataFrame, key: str = "doc_id", text_col: str = "text", max_words: int = MAX_WORDS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs``, all columns kept.

    Scores are sorted without texts; a row is drawn if its score lies above that of the last one, and rows with just that score by their numbers.
    """
    found = C.stage(scored(docs, target, key, text_col, max_words, seed=seed).withColumn("_row", F.monotonically_increasing_id()), "scored")
    rows = found.select(F.col(f"{C.CARRIED}.`{key}`").alias("_key"), "n_words", "score", "_row")
    took = ranked(rows, "_key", least_words, per_cent).filter("rank is not null").select(F.col("_row").alias("_took"))
    return found.join(took, F.col("_row") == F.col("_took"), "left_semi").select(f"{C.CARRIED}.*")


#: crc32 by its table of 256 steps, over the bytes of each distinct word.
CRC = """tab AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(b)))"""


def crc_sql(text: str) -> str:
    """DuckDB expression of a text's crc32; needs the CTE ``tab`` in FROM."""
    byte = f"CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})), lambda i: {byte})), lambda a, x: xor(a >> 8, tab.t[xor(a, x) % 256 + 1])))"


ORACLE = f"""
WITH {CRC}, d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), x AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{C.UPPER}', '{C.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), dw AS (SELECT r, unnest(w) AS w FROM d), xw AS (SELECT unnest(w) AS w FROM x
), words AS (SELECT w, {crc_sql('w')} % {BUCKETS} AS b FROM (SELECT w FROM dw UNION SELECT w FROM xw), tab
), s AS (SELECT b, count(*) AS n FROM dw JOIN words USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM xw JOIN words USING (w) GROUP BY b
), totals AS (SELECT (SELECT count(*) FROM dw) AS sn, (SELECT count(*) FROM xw) AS tn
), gain AS (
  SELECT b, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST(sn + {BUCKETS} AS DOUBLE) / (CAST(coalesce(s.n, 0) + 1 AS DOUBLE) * CAST(tn + {BUCKETS} AS DOUBLE)))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (b), totals
), weights AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN words USING (w) JOIN gain USING (b) GROUP BY r
), scores AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN weights USING (r)
), placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PER_CENT} * n // 100 THEN place END AS rank FROM placed
"""
