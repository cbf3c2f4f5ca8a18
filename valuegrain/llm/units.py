"""Substring dedup by hashing lines, paragraphs or sentences.

Each text's units are normalised (A-Z lower-cased, blanks collapsed) and digested in one narrow
pass. Digests are grouped globally with partial aggregation, only the earliest occurrence of each
repeated digest is carried on, and the other occurrences are found by a join of small rows, which
adaptive execution can split where one digest is hot. Repeated units of a document that follow each
other make a run; a run with enough words goes, with the original offsets of its units.

A passage that recurs inside other lines shares no whole line with its other copies; sentences find more of them, at
several times the rows and disk. Runs keep sound documents whole: short units recur by chance, but hardly in a row.

Earliest means the smallest key, then the smallest start; a null key comes last. Rows with the
same key and text are one document and get the same result. Defined cases: a null text stays null and has no
units; units without a word are never removed and don't end a run; of what stays, each unit keeps the separator before it,
but for the first; a text of which all units go becomes empty; an empty table gives an empty result; a column
named ``removed`` is replaced by the new one.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C

#: Words that a run of repeated units must have to go.
RUN_WORDS = 15
#: What stands between two units.
SEPARATORS = {"line": "\n", "paragraph": "\n\n", "sentence": r"\n|(?<=[.!?])[ \t]+"}
PLACES = ("nth", "at", "begin", "start", "end", "next", "words")
UNIT = T.StructType([*[T.StructField(n, T.IntegerType()) for n in PLACES], T.StructField("high", T.LongType()), T.StructField("low", T.LongType())])


def units_of(text: str | None, separator: re.Pattern) -> list[tuple]:
    """(number among units with a word, number, start of the separator before, start, end, start of the next, words, digest) of each unit with a word."""
    if not text:
        return []
    found, begin, start = [], 0, 0
    for at, m in enumerate([*separator.finditer(text), None]):
        end, after = m.span() if m else (len(text), len(text))
        words = C.utf8_lower(text[start:end]).split()
        if words:
            d = xxhash.xxh3_128_digest(b" ".join(words))
            found.append((len(found), at, begin, start, end, after, len(words), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
        begin, start = end, after
    return found


def with_units(docs: DataFrame, text_col: str, separator: str) -> DataFrame:
    def make():
        pattern = re.compile(separator)

        def work(texts):
            rows = [units_of(t, pattern) for t in texts]
            flat = [u for own in rows for u in own]
            offsets = [0]
            for own in rows:
                offsets.append(offsets[-1] + len(own))
            items = pa.StructArray.from_arrays([pa.array([u[i] for u in flat], C.to_arrow(f.dataType)) for i, f in enumerate(UNIT)], names=UNIT.names)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)]

        return work

    return C.map_texts(docs, text_col, [("units", T.ArrayType(UNIT))], make, carry=["_key", "_hash"])


def removals(docs: DataFrame, key: str, text_col: str, unit: str = "line", run_words: int = RUN_WORDS) -> DataFrame:
    """(_key, _hash, removed): for each distinct document that loses units those that go, as (at, begin, start, end, next) in order."""
    own = docs.select(F.col(key).alias("_key"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_own")).filter(F.col("_own").isNotNull())
    found = with_units(own, "_own", SEPARATORS[unit])
    passed = C.stage(found.select(*C.unpack(found, "_key", "_hash"), "units"), "units")
    exploded = passed.select("_key", "_hash", F.explode("units").alias("u")).select("_key", "_hash", "u.*")
    # texts of the same key and hash are one document: its unit counts once
    place = F.struct(F.col("_key").isNull().alias("last"), "_key", "_hash", "start")
    first = C.stage(exploded.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("final")).filter(~F.col("first").eqNullSafe(F.col("final"))).select("high", "low", "first"), "firsts")
    again = exploded.join(first, ["high", "low"]).filter(~place.eqNullSafe(F.col("first"))).select("_key", "_hash", *PLACES)
    document = Window.partitionBy("_key", "_hash")  # the steps below need no other partitioning
    once = again.dropDuplicates(["_key", "_hash", "nth"]).withColumn("run", F.col("nth") - F.row_number().over(document.orderBy("nth")))
    total = F.sum("words").over(Window.partitionBy("_key", "_hash", "run"))
    return once.withColumn("total", total).filter(F.col("total") >= run_words).groupBy("_key", "_hash").agg(F.array_sort(F.collect_list(F.struct("at", "begin", "start", "end", "next"))).alias("removed"))


def dedup(docs: DataFrame, key: str = "doc_id", text_col: str = "text", unit: str = "line", run_words: int = RUN_WORDS) -> DataFrame:
    """All columns, the text without its repeated units, and ``removed`` with their original offsets."""
    gone = removals(docs, key, text_col, unit, run_words)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(C.CARRIED), F.col(key).alias("_k"), F.xxhash64(text_col).alias("_h"), F.col(text_col).alias("_text"))
    joined = packed.join(gone, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash")), "left")
    # what follows units removed from the start on comes first and has no separator
    starts = F.concat(F.array(F.lit(0)), F.transform("removed", lambda r, i: F.when(r["at"] == i, r["next"]).otherwise(r["end"])))
    ends = F.concat(F.transform("removed", lambda r: r["begin"]), F.array(F.char_length("_text")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.substring("_text", a + 1, b - a))
    text = F.when(F.col("removed").isNull(), F.col("_text")).otherwise(F.array_join(pieces, ""))
    none = F.array().cast("array<struct<at:int,start:int,end:int>>")
    shown = F.transform("removed", lambda r: F.struct(r["at"].alias("at"), r["start"].alias("start"), r["end"].alias("end")))
    done = joined.select(C.CARRIED, text.alias("_kept"), F.coalesce(shown, none).alias("removed"))
    return done.select(*[F.col("_kept").alias(c) if c == text_col else F.col(f"{C.CARRIED}.`{c}`").alias(c) for c in docs.columns if c != "removed"], "removed")


def judge(docs: DataFrame, key: str = "doc_id", text_col: str = "text", unit: str = "line", run_words: int = RUN_WORDS) -> DataFrame:
    """(key, n_removed, removed as start:end, text) for each row."""
    done = dedup(docs.select(key, text_col), key, text_col, unit, run_words)
    spans = F.concat_ws(",", F.transform("removed", lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))))
    return done.select(key, F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), F.col(text_col).alias("text"))


#: chr(1) stands on both sides of a separator, so units and separators take turns.
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(regexp_replace(text, '\\n', chr(1) || chr(10) || chr(1), 'g'), chr(1)) AS parts FROM documents
), p AS (SELECT r, doc_id, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM d WHERE text IS NOT NULL
), o AS (
  SELECT *, CAST(coalesce(sum(length(part)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, length(part) AS n, coalesce(lag(part) OVER (PARTITION BY r ORDER BY i), '') AS before,
    trim(regexp_replace(translate(part, '{C.UPPER}', '{C.LOWER}'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm
  FROM p
), u AS (SELECT * FROM o WHERE i % 2 = 1
), k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, r, s) AS nth, row_number() OVER (PARTITION BY r ORDER BY i) AS pos, len(string_split(norm, ' ')) AS words FROM u WHERE norm <> ''
), runs AS (SELECT *, pos - row_number() OVER (PARTITION BY r ORDER BY i) AS run FROM k WHERE nth > 1
), gone AS (SELECT r, i, s, n FROM (SELECT *, sum(words) OVER (PARTITION BY r, run) AS total FROM runs) WHERE total >= {RUN_WORDS}
), g AS (SELECT r, count(*) AS n_removed, string_agg(s || ':' || (s + n), ',' ORDER BY s) AS removed FROM gone GROUP BY r
), left_over AS (SELECT u.*, row_number() OVER (PARTITION BY u.r ORDER BY u.i) AS place FROM u LEFT JOIN gone USING (r, i) WHERE gone.r IS NULL
), kept AS (SELECT r, string_agg(CASE WHEN place = 1 THEN part ELSE before || part END, '' ORDER BY i) AS text FROM left_over GROUP BY r)
SELECT d.doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM d LEFT JOIN g USING (r) LEFT JOIN kept USING (r)
"""
