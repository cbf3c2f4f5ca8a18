"""Global order on many tasks: places in a sort, running sums over dense places, and places in a linked list.

Nothing here holds more than a bounded piece of the order in one task, whatever the keys: sorts are by range, running sums
go by chunks of places and then over the chunks' totals, and a list is shortened by random mates until ``BASE`` elements are left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuegrain.llm import common as C

#: Bits of a row's place inside its partition in ``monotonically_increasing_id``.
INSIDE = 33
#: Places whose running sums one task makes at a time; elements of a list that the driver walks.
CHUNK_BITS, BASE = 12, 4096


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place in the order, from 0; equal rows in any order. The sorted rows are staged."""
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = C.stage(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", INSIDE)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition of the sort
    joined = placed.join(F.broadcast(before), part == F.col("_part"))
    return joined.select(*df.columns, (F.col("_at").bitwiseAND((1 << INSIDE) - 1) + F.col("_before")).alias(name))


def running(df: DataFrame, at: str, sums: list[str], bits: int = CHUNK_BITS) -> DataFrame:
    """``df`` with each of the columns ``sums`` as its sum over all rows up to this one; places ``at`` are dense from 0."""
    own = df.withColumn("_chunk", F.shiftright(at, bits))
    inside = own.withColumns({c: F.sum(c).over(Window.partitionBy("_chunk").orderBy(at)) for c in sums})
    totals = C.stage(own.groupBy("_chunk").agg(*[F.sum(c).alias(c) for c in sums]), "totals")
    if totals.count() < 2:
        return inside.drop("_chunk")
    upto = running(totals.withColumnRenamed("_chunk", "at"), "at", sums, bits).select((F.col("at") + 1).alias("_next"), *[F.col(c).alias(f"_{c}") for c in sums])
    joined = inside.join(upto, F.col("_chunk") == F.col("_next"), "left")
    return joined.select(*[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) if c in sums else F.col(c) for c in df.columns])


def list_places(links: DataFrame, base: int = BASE) -> DataFrame:
    """(id, place) of the elements of one list (id, next), from 0; the last one's ``next`` is null.

    A round flips a coin for each element; one that shows tails behind one that shows heads is spliced out, its distance from
    that one noted. So a quarter goes each round, and all rounds together move a few times the list. The rest, at most
    ``base`` elements, is walked; then the rounds are undone, each by one join with what has its place already.
    """
    spark = links.sparkSession
    left, rounds = C.stage(links.select("id", "next", F.lit(1).cast("long").alias("steps")), "list"), []
    while left.count() > base:
        coin = lambda c, seed=len(rounds): F.pmod(F.xxhash64(F.lit(seed), F.col(c)), F.lit(2))
        heads, tails = left.filter(coin("id") == 1), left.filter(coin("id") == 0)
        before = heads.filter(coin("next") == 0).select(F.col("id").alias("_id"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        met = tails.join(before, F.col("id") == F.col("_next"), "left")
        spliced = met.select(
            F.coalesce("_id", "id").alias("id"), "next", (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.when(F.col("_id").isNotNull(), F.col("id")).alias("gone"), F.col("_steps").alias("off"),
        )
        others = heads.filter(F.col("next").isNull() | (coin("next") == 1)).select("*", F.lit(None).cast("long").alias("gone"), F.lit(None).cast("long").alias("off"))
        done = C.stage(spliced.unionByName(others), "list")
        if not rounds:
            C.drop_stage(left)
        rounds.append(done)
        left = done.select("id", "next", "steps")
    rest = {r["id"]: (r["next"], r["steps"]) for r in left.collect()}
    at, place, walked = next(iter(rest.keys() - {n for n, _ in rest.values()}), None), 0, []
    while at is not None:
        walked.append((at, place))
        at, place = rest[at][0], place + rest[at][1]
    known = [spark.createDataFrame(walked, "id long, place long")]
    for done in reversed(rounds):
        own = done.filter("gone is not null").select("gone", F.col("id").alias("_id"), "off")
        found = own.join(reduce(DataFrame.unionByName, known), F.col("_id") == F.col("id")).select(F.col("gone").alias("id"), (F.col("place") + F.col("off")).alias("place"))
        known.append(C.stage(found, "places"))
        C.drop_stage(done)
    return reduce(DataFrame.unionByName, known)
