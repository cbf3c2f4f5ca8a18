"""Benchmark decontamination with DataFrame functions only.

The benchmark's n-grams (windows of ``WINDOW`` words; a shorter item is one window) become hash sets
that every task holds: the window texts, their first and their last words. A training window is looked
at only where its first and last word are in those sets, and is hit only if its whole text is in the
set, so no hash collision counts. A set has at most ``SHARD`` windows, whatever the benchmark: a larger
one is cut by a hash of the window, and each set takes one narrow pass over the texts. Passes leave
only (row, window) of what they hit; texts are shuffled, once and for the rows' numbers, only where
there were several passes and many hits.

Defined cases: a null text or one without words has no windows, no hits and is clean; a null item
has no windows; repeated items count with each of their ids; repeated rows are judged each; an empty
benchmark hits nothing; an empty table gives an empty result; texts of any length are judged whole;
extra columns are not read by ``judge`` and are kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.llm import common as C

WINDOW = 13
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Windows that a set which is sent to every task has at most.
SHARD = 50_000


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; none for a null."""
    return F.array_remove(F.split(C.lower_az(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, key: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, n, window): distinct windows of every item, n words each."""
    items = benchmark.select(F.col(key).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return items.select("item", n.alias("n"), F.explode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("w", i, n)))).alias("window")).distinct()


def _hits_of_set(grams: list[tuple[int, str]]) -> Column:
    """Array of (start, n) of the windows of column ``w`` that are in the set; starts count from 0."""
    found = []
    for n in sorted({n for n, _ in grams}):
        own = sorted(g for k, g in grams if k == n)
        first, last = sorted({g.split(" ", 1)[0] for g in own}), sorted({g.rsplit(" ", 1)[-1] for g in own})
        found.append(_hits_of_length(n, own, first, last))
    return F.concat(*found) if len(found) > 1 else found[0] if found else _no_hits()


def _no_hits() -> Column:
    return F.array().cast("array<struct<start:int,n:int>>")


def _listed(own: list[str]) -> str:
    """Texts as SQL: words have no character that needs escaping. One text, as a list of 50,000 literals takes minutes to hand over."""
    return ", ".join(f"'{x}'" for x in own)


def _hits_of_length(n: int, own: list[str], first: list[str], last: list[str]) -> Column:
    """A window's words are joined only between a first and a last word that fit."""
    inside = f"get(w, i) IN ({_listed(first)}) AND get(w, i + {n - 1}) IN ({_listed(last)}) AND concat_ws(' ', slice(w, i + 1, {n})) IN ({_listed(own)})"
    hit = F.expr(f"filter(sequence(0, size(w) - {n}), i -> {inside})")
    return F.when(F.size("w") >= n, F.transform(hit, lambda i: F.struct(i.alias("start"), F.lit(n).alias("n")))).otherwise(_no_hits())


def _n_hit(hits: Column) -> Column:
    """Words inside the union of the windows: sorted by start, each adds what lies beyond the end so far."""
    union = F.aggregate(
        F.array_sort(hits),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda a, h: F.struct(F.greatest(a["end"], h["start"] + h["n"]).alias("end"), (a["total"] + F.greatest(F.lit(0), h["start"] + h["n"] - F.greatest(a["end"], h["start"]))).alias("total")),
        lambda a: a["total"],
    )
    return F.when(F.size(hits) == 0, F.lit(0)).otherwise(union).cast("long")


def sets_of(windows: DataFrame, shard: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct (n, window) in lists of at most ``shard``, one at a time on the driver."""
    pieces = max(1, ceil(windows.count() / shard))
    while windows.groupBy(F.pmod(F.xxhash64("window"), F.lit(pieces))).count().filter(F.col("count") > shard).limit(1).count():
        pieces += ceil(pieces / 4)
    for i in range(pieces):
        yield [(r["n"], r["window"]) for r in windows.filter(F.pmod(F.xxhash64("window"), F.lit(pieces)) == i).collect()]


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Documents as struct ``_carried`` with ``_row``, ``w``, ``hits``; and the benchmark's windows."""
    grams = C.stage(benchmark_windows(benchmark, item_key, item_text, window), "grams")
    distinct = C.stage(grams.select("n", "window").distinct(), "windows")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(C.CARRIED)).withColumn("_row", F.monotonically_increasing_id())
    w = words(F.col(f"{C.CARRIED}.`{text_col}`")).alias("w")
    sets = sets_of(distinct, shard)
    first, second = next(sets), next(sets, None)
    if second is None:
        return packed.select(C.CARRIED, "_row", w).withColumn("hits", _hits_of_set(first)), grams
    packed = C.stage(packed, "numbered")  # the rows' numbers stay as they are for the join back
    passes = [C.stage(packed.select("_row", w).select("_row", F.explode(_hits_of_set(own)).alias("hit")), "hits") for own in chain((first, second), sets)]
    hits = reduce(DataFrame.unionByName, passes).groupBy(F.col("_row").alias("_of")).agg(F.collect_list("hit").alias("hits"))
    return packed.join(hits, F.col("_row") == F.col("_of"), "left").select(C.CARRIED, "_row", w, F.coalesce("hits", _no_hits()).alias("hits")), grams


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (F.lit(ONE_IN) * n_hit >= n_words)


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs``.

    Each row leaves one small row with the texts of the windows it hit; only rows with hits meet the items.
    """
    found, grams = with_hits(docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text_col}`").alias("_text")), benchmark, "_text", shard=shard)
    hit_texts = F.array_distinct(F.transform("hits", lambda h: F.concat_ws(" ", F.slice("w", h["start"] + 1, h["n"]))))
    rows = C.stage(found.select("_row", F.col(f"{C.CARRIED}._key").alias("_key"), F.size("w").cast("long").alias("n_words"), _n_hit(F.col("hits")).alias("n_hit"), hit_texts.alias("windows")), "hit")
    hit = rows.filter("n_hit > 0").select("_row", F.explode("windows").alias("window"))
    matched = hit.join(grams.select("window", F.col("item").cast("string").alias("item")), "window")
    items = matched.groupBy(F.col("_row").alias("_of")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    done = rows.drop("windows").join(items, F.col("_row") == F.col("_of"), "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return done.select(
        F.col("_key").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns kept."""
    found, _ = with_hits(docs, benchmark, text_col, shard=shard)
    counted = found.select(C.CARRIED, _n_hit(F.col("hits")).alias("_hit"), F.size("w").cast("long").alias("_all"))
    # the row number keeps the filter above: pushed down, it would split the text again for every word
    judged = counted.select(C.CARRIED, contaminated(F.col("_hit"), F.col("_all")).alias("_bad"), F.monotonically_increasing_id().alias("_row"))
    return judged.filter("not _bad and _row >= 0").select(f"{C.CARRIED}.*")


def without_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """All rows; hit words are cut from the words of contaminated texts, other texts stay as they are."""
    found, _ = with_hits(docs, benchmark, text_col, shard=shard)
    hit_at = F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["n"] - 1)))
    rest = F.concat_ws(" ", F.filter("w", lambda _, i: ~F.array_contains("hit_at", i)))
    cut = found.withColumn("hit_at", F.array_distinct(hit_at))
    bad = contaminated(_n_hit(F.col("hits")), F.size("w").cast("long"))
    text = F.when(bad, rest).otherwise(F.col(f"{C.CARRIED}.`{text_col}`"))
    return cut.select(*[text.alias(c) if c == text_col else F.col(f"{C.CARRIED}.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), hits AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, g)
), pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
