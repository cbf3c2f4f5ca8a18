"""A topological order kept with the graph, so that a batch of new edges is checked against a part of it only.

Every node has a level, and a stored edge goes from a lower level to a higher one. A new edge that does so too closes no
cycle by itself; every cycle holds an edge against the order, and all its nodes have levels between those of such edges'
ends. So only stored edges within that band are read. Edges carry their ends' levels (``parent_level``, ``child_level``), so
files sorted by level are read in that band alone: both bounds are pushed to the scan. A cycle goes down over each level that
it goes up over, so it stays in one stretch of levels that such edges span without a gap; edges that leave a stretch are left
out, and where such edges are few, all that their heads don't reach. An accepted edge against the order raises its child, and what follows from it, as far as levels collide.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuegrain.operators.contract import union
from valuegrain.operators.graph import on_cycles, reach
from valuegrain.sources.staging import stage


#: Parts of a band of levels, in each of which stretches are found and looked up; stored edges for each edge against the order from which on a search pays.
BLOCKS, FEW = 100_000, 1000


class Admitted(NamedTuple):
    """What became of a batch: new edges taken and refused, and the levels (id, level) of new nodes and of those raised."""

    accepted: DataFrame
    refused: DataFrame
    changed: DataFrame


def levelled(edges: DataFrame, levels: DataFrame) -> DataFrame:
    """Edges with the levels of their ends."""
    plain = edges.drop("parent_level", "child_level")
    side = lambda p: levels.select(F.col("id").alias(f"_{p}"), F.col("level").alias(f"{p}_level"))
    met = plain.join(side("parent"), F.col("parent_id") == F.col("_parent")).join(side("child"), F.col("child_id") == F.col("_child"))
    return met.select(*plain.columns, "parent_level", "child_level")


def band(edges: DataFrame, low: int, high: int) -> DataFrame:
    """Levelled edges that can lie on a cycle of edges against the order between these levels."""
    return edges.filter((F.col("parent_level") >= low) & (F.col("child_level") <= high))


def _upto(value: Column, last: int, blocks: DataFrame, own: DataFrame) -> DataFrame:
    """``own`` (low, block, ...) with ``upto``, the largest value in order of ``low``: up to the row itself (``last`` 0) or to the one before (-1). One task orders blocks, not rows."""
    tops = own.groupBy("block").agg(F.max(value).alias("_top"))
    before = blocks.join(tops, "block", "left").select(F.col("block").alias("_b"), F.max("_top").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    within = F.max(value).over(Window.partitionBy("block").orderBy("low").rowsBetween(Window.unboundedPreceding, last))
    met = own.withColumn("_within", within).join(before, F.col("block") == F.col("_b"))
    return met.withColumn("upto", F.greatest("_within", "_before")).drop("_within", "_before", "_b")


def _block(level: Column, low: int, high: int) -> Column:
    return F.floor((level - F.lit(low)) / ((high - low) // BLOCKS + 1))


def stretches(against: DataFrame, low: int, high: int) -> DataFrame:
    """(low, high) of the stretches of levels that edges against the order span between these bounds; any two have a gap between them."""
    own = against.groupBy(F.col("child_level").alias("low")).agg(F.max("parent_level").alias("high")).withColumn("block", _block(F.col("low"), low, high))
    own = stage(own, "spans")
    blocks = stage(own.select("block").distinct(), "blocks")
    first = _upto(F.col("high"), -1, blocks, own).withColumn("first", F.when(F.col("upto").isNull() | (F.col("low") > F.col("upto")), F.col("low"))).drop("upto")
    return _upto(F.col("first"), 0, blocks, stage(first, "spans")).groupBy(F.col("upto").alias("low")).agg(F.max("high").alias("high"))


def _inside(edges: DataFrame, parts: DataFrame, low: int, high: int) -> DataFrame:
    """Levelled edges with both ends in one of the stretches (low, high)."""
    at = parts.select(F.col("low").alias("_low"), F.col("high").alias("_high"), F.explode(F.sequence(_block(F.col("low"), low, high), _block(F.col("high"), low, high))).alias("_block"))
    ends = [F.col(f"{p}_level").between(F.col("_low"), F.col("_high")) for p in ("parent", "child")]
    return edges.join(at, (_block(F.col("parent_level"), low, high) == F.col("_block")) & ends[0] & ends[1]).select("parent_id", "child_id")


def _starting(new: DataFrame, levels: DataFrame) -> DataFrame:
    """(id, level, fresh) of the batch's nodes: stored levels, and for new nodes one above their highest stored parent, 0 without any."""
    ends = new.select(F.explode(F.array("parent_id", "child_id")).alias("id")).distinct()
    stored = ends.join(levels.select(F.col("id").alias("_l"), "level"), F.col("id") == F.col("_l"), "left").select("id", "level")
    stored = stage(stored, "stored")
    over = new.join(stored, F.col("parent_id") == F.col("id")).groupBy(F.col("child_id").alias("_c")).agg((F.max("level") + 1).alias("over"))
    met = stored.join(over, F.col("id") == F.col("_c"), "left")
    return met.select("id", F.coalesce("level", "over", F.lit(0).cast("long")).alias("level"), F.col("level").isNull().alias("fresh"))


def _raised(edges: DataFrame, accepted: DataFrame, low: int) -> DataFrame:
    """(id, level) of nodes that must rise for accepted edges (with levels) to keep the order: one join a step, with the edges that collide alone."""
    pending = accepted.filter("parent_level >= child_level").groupBy(F.col("child_id").alias("id")).agg((F.max("parent_level") + 1).alias("level"))
    raised = frontier = stage(pending, "raised")
    every = accepted.select("parent_id", "child_id", "child_level")
    while True:
        bounds = frontier.agg(F.max("level")).first()[0]
        if bounds is None:
            return raised
        near = band(edges, low, bounds).select("parent_id", "child_id", "child_level").unionByName(every)
        risen = raised.select(F.col("id").alias("_r"), F.col("level").alias("_now"))
        met = frontier.join(near, F.col("id") == F.col("parent_id")).join(risen, F.col("child_id") == F.col("_r"), "left")
        collide = met.filter(F.greatest("child_level", F.coalesce("_now", "child_level")) <= F.col("level"))
        frontier = stage(collide.groupBy(F.col("child_id").alias("id")).agg((F.max("level") + 1).alias("level")), "raised")
        raised = stage(raised.unionByName(frontier).groupBy("id").agg(F.max("level").alias("level")), "raised")


def admit(edges: DataFrame, levels: DataFrame, new: DataFrame) -> Admitted:
    """Check new edges (parent_id, child_id, ...) against stored levelled ones; those on a cycle of stored and new edges are refused.

    Repeated edges are judged alike; without stored edges the batch alone is ordered; an empty batch changes nothing.
    """
    starting = stage(_starting(new, levels), "starting")
    own = stage(levelled(new, starting), "new")
    against = own.filter("parent_level >= child_level")
    low, high = against.agg(F.min("child_level"), F.max("parent_level")).first()
    fresh = starting.filter("fresh").select("id", "level")
    if low is None:
        return Admitted(own.select(*new.columns), own.select(*new.columns).limit(0), fresh)
    columns = ["parent_id", "child_id", "parent_level", "child_level"]
    parts = stage(stretches(against, low, high), "stretches")
    inside = stage(_inside(band(edges.select(*columns).unionByName(own.select(*columns)), low, high), parts, low, high), "inside")
    judged = _inside(own, parts, low, high)
    if against.count() * FEW < inside.count():
        met = stage(reach(inside, against.select(F.col("child_id").alias("id")).distinct()).select(F.col("id").alias("_in")), "met")
        inside = inside.join(met, F.col("parent_id") == F.col("_in"), "left_semi").join(met, F.col("child_id") == F.col("_in"), "left_semi")
        judged = judged.join(met, F.col("parent_id") == F.col("_in"), "left_semi")
    refused = stage(on_cycles(inside, judged), "refused")
    accepted = stage(own.join(refused, ["parent_id", "child_id"], "left_anti").select(*own.columns), "accepted")
    raised = _raised(edges, accepted, low)
    changed = stage(union([fresh, raised]).groupBy("id").agg(F.max("level").alias("level")), "changed")
    return Admitted(accepted.select(*new.columns), own.join(refused, ["parent_id", "child_id"], "left_semi").select(*new.columns), changed)


def applied(edges: DataFrame, levels: DataFrame, batch: Admitted) -> tuple[DataFrame, DataFrame]:
    """(edges, levels) after a batch: accepted edges joined, changed levels in place of old ones; edges carry the levels of their ends."""
    changed = batch.changed.select(F.col("id").alias("_c"), F.col("level").alias("_level"))
    kept = levels.join(changed, F.col("id") == F.col("_c"), "left_anti").select("id", "level")
    after = stage(kept.unionByName(batch.changed.select("id", "level")), "levels")
    plain = edges.drop("parent_level", "child_level")
    every = plain.unionByName(batch.accepted.select(*plain.columns)).dropDuplicates(["parent_id", "child_id"])
    return levelled(every, after), after


def ordered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levelled edges, levels) of a graph without cycles, in one batch."""
    none = edges.limit(0).select("parent_id", "child_id", F.lit(0).cast("long").alias("parent_level"), F.lit(0).cast("long").alias("child_level"))
    nowhere = edges.limit(0).select(F.col("parent_id").alias("id"), F.lit(0).cast("long").alias("level"))
    batch = admit(none, nowhere, edges)
    changed = batch.changed
    return levelled(batch.accepted, changed), changed
