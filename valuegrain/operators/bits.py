"""Searches from many starts at once, with sets of starts as bits.

Starts are numbered in order and 64 of them share a word, so what a level carries is (node, word, bits) and not a row for
each start and node; sets that meet at a node are joined by bitwise or, before the shuffle too. Starts that are near in
order are mostly near in the graph, so few words are sparse. A level takes one join with the edges and one grouping, in
which the bits that were seen before are removed.

Defined cases: a repeated start counts once; a null root is one like others; a null id is kept and leads nowhere; no starts
give nothing; cycles end, as no bit is new a second time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.operators.contract import union
from valuegrain.sources.staging import drop_stage, stage

#: Starts in a word.
WIDTH = 64
#: Tables that what was seen may lie in.
TABLES = 8


class Searched(NamedTuple):
    """``found``: (id, word, bits, depth), each bit once a node; ``frontier``: those of the last level; ``words``: (word, slots of (bit, root))."""

    found: DataFrame
    frontier: DataFrame
    words: DataFrame


def numbered(starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words, sets) of starts (root, id): the roots of each word, and (id, word, bits)."""
    places = starts.select(F.col("root").alias("_r")).distinct().orderBy("_r").withColumn("_n", F.monotonically_increasing_id())
    places = stage(places.select("_r", F.floor(F.col("_n") / WIDTH).alias("word"), (F.col("_n") % WIDTH).cast("int").alias("bit")), "places")
    words = stage(places.groupBy("word").agg(F.collect_list(F.struct("bit", F.col("_r").alias("root"))).alias("slots")), "words")
    own = starts.join(places, F.col("root").eqNullSafe(F.col("_r"))).groupBy("id", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    return words, own


def search(steps: DataFrame, starts: DataFrame, most: int | None) -> Searched:
    """All that starts (root, id) reach over steps (_near, _far) in at most so many levels."""
    words, own = numbered(starts)
    frontier = stage(own.withColumn("depth", F.lit(0)), "bits")
    found, depth, none = [frontier], 0, F.lit(0).cast("long")
    while most is None or depth < most:
        if len(found) > TABLES:
            merged = stage(union(found), "bits")
            drop_stage(*found[:-1])  # the last one is still read
            found = [merged]
        met = frontier.join(steps, F.col("id") == F.col("_near")).select(F.col("_far").alias("id"), "word", F.col("bits").alias("new"), none.alias("old"))
        seen = union(found).select("id", "word", none.alias("new"), F.col("bits").alias("old"))
        both = met.unionByName(seen).groupBy("id", "word").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        fresh = both.select("id", "word", F.expr("new & ~old").alias("bits"), F.lit(depth + 1).alias("depth")).filter("bits <> 0")
        frontier = stage(fresh, "bits")
        if frontier.isEmpty():
            break
        found.append(frontier)
        depth += 1
    return Searched(union(found), frontier, words)


def expanded(sets: DataFrame, words: DataFrame) -> DataFrame:
    """(root, id, depth) of each bit."""
    met = sets.join(words.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"))
    return met.select(F.explode(F.expr("filter(slots, s -> (shiftright(bits, s.bit) & 1) = 1)")).alias("slot"), "id", "depth").select("slot.root", "id", "depth")


def counted(sets: DataFrame) -> DataFrame:
    """(id, n_starts): how many starts reach each node, counted without expanding a set."""
    return sets.groupBy("id").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_starts"))
