"""Reachability over derivation edges, as loops of joins.

Every loop step joins the frontier with the edges, removes what was seen by an anti join and
stages the new frontier, so plans stay short and nothing is collected but a count. What was seen is
one table, rewritten every few levels. Beyond ``LEVELS`` levels the rest of the graph is contracted first.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.operators import bits
from valuegrain.operators.contract import deep_reach, strong_components, union
from valuegrain.sources.staging import PACKED, drop_stage, stage

#: Levels that are searched edge by edge; tables that the seen ones may lie in.
LEVELS, TABLES = 16, 8
#: Root of a search that all starts share.
NO_ROOT = "cast(null as string) as root"
STALE_PARENT, MODIFIED, DELETED = "PARENT_NODE_STALE", "SOURCE_FILE_MODIFIED", "FILE_DELETED"


def _steps(edges: DataFrame, down: bool) -> DataFrame:
    """(_near, _far), dealt by the near end and sorted once for all levels; to be unpersisted after the search. A repeated one changes nothing."""
    near, far = ("parent_id", "child_id") if down else ("child_id", "parent_id")
    own = edges.select(F.col(near).alias("_near"), F.col(far).alias("_far"))
    return own.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_near").sortWithinPartitions("_near").persist(StorageLevel.DISK_ONLY)


def reach(edges: DataFrame, starts: DataFrame, down: bool = True, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth) of everything each start reaches, starts included at depth 0; shortest depth, safe on cycles.

    ``starts`` has ``id``, or ``root`` and ``id``. Without ``root`` all starts share one search; with it sets of roots are
    carried as bits. What lies beyond ``LEVELS`` is reached from the last level's nodes over the edges that they can reach,
    trees and chains without a search.
    """
    steps = _steps(edges, down)
    found = _reach_each(steps, starts, max_depth) if "root" in starts.columns else _reach_all(steps, starts, max_depth)
    steps.unpersist()  # what was found is staged
    return found


def _reach_all(steps: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """``reach`` without roots."""
    frontier = stage(starts.select("id").distinct().withColumn("depth", F.lit(0)), "frontier", PACKED)
    found, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        if len(found) > TABLES:
            seen = stage(union(found), "seen")
            drop_stage(*found[:-1])  # the last one is still read
            found = [seen]
        seen = union(found).select(F.col("id").alias("_i"))
        if depth == LEVELS:
            deep = deep_reach(_rest(steps, frontier, seen), frontier.selectExpr(NO_ROOT, "id", "depth"))
            found.append(stage(_within(deep, max_depth).join(seen, F.col("id") == F.col("_i"), "left_anti").select("id", "depth"), "deep"))
            break
        met = frontier.select("id").join(steps, F.col("id") == F.col("_near")).select(F.col("_far").alias("id")).distinct()
        new = stage(met.join(seen, F.col("id") == F.col("_i"), "left_anti").withColumn("depth", F.lit(depth + 1)), "frontier", PACKED)
        if new.isEmpty():
            break
        found.append(new)
        depth += 1
        frontier = new
    return union(found).selectExpr(NO_ROOT, "id", "depth")


def _reach_each(steps: DataFrame, starts: DataFrame, max_depth: int | None) -> DataFrame:
    """``reach`` with roots: bits for the first ``LEVELS`` levels, rows of (root, id) beyond."""
    own = bits.search(steps, starts.select("root", "id").distinct(), LEVELS if max_depth is None else min(LEVELS, max_depth))
    found = bits.expanded(own.found, own.words)
    if (max_depth is not None and max_depth <= LEVELS) or own.frontier.isEmpty():
        return found
    frontier = stage(bits.expanded(own.frontier, own.words), "frontier")
    inside = reach(steps.select(F.col("_near").alias("parent_id"), F.col("_far").alias("child_id")), frontier.select("id").distinct()).select(F.col("id").alias("_in"))
    rest = stage(steps.join(inside, F.col("_near") == F.col("_in"), "left_semi"), "rest")
    seen = found.select(F.col("root").alias("_r"), F.col("id").alias("_i"))
    deep = _within(deep_reach(rest, frontier), max_depth).join(seen, F.col("root").eqNullSafe(F.col("_r")) & (F.col("id") == F.col("_i")), "left_anti")
    return found.unionByName(stage(deep, "deep"))


def start_counts(edges: DataFrame, starts: DataFrame, down: bool = True) -> DataFrame:
    """(id, n_starts): how many of the starts (id) reach each node, themselves included. No set is expanded within ``LEVELS`` levels."""
    steps = _steps(edges, down)
    own = bits.search(steps, starts.select(F.col("id").alias("root"), "id").distinct(), LEVELS)
    steps.unpersist()
    if own.frontier.isEmpty():
        return bits.counted(own.found)
    return reach(edges, starts.select(F.col("id").alias("root"), "id"), down).groupBy("id").agg(F.count("*").alias("n_starts"))


def _within(found: DataFrame, max_depth: int | None) -> DataFrame:
    return found.filter(F.lit(max_depth is None) | (F.col("depth") <= (max_depth or 0))).withColumn("depth", F.col("depth").cast("int"))


def _rest(steps: DataFrame, frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """The steps that a shared search can still take: those to nodes not seen, and not from those that it has passed."""
    done = seen.select("_i").distinct()
    passed = done.join(frontier.select("id"), F.col("_i") == F.col("id"), "left_anti")
    return stage(steps.join(done, F.col("_far") == F.col("_i"), "left_anti").join(passed, F.col("_near") == F.col("_i"), "left_anti"), "rest")


def cascade(nodes: DataFrame, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes after staleness spread: a start (id, reason) has its own reason, whatever derives from it the parent's.

    A start that derives from another start keeps its reason; repeated starts take the smallest reason.
    """
    return mark_stale(nodes, marks(edges, starts))


def marks(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(_id, _reason) of the starts and all that derives from them."""
    own = starts.groupBy("id").agg(F.min("reason").alias("reason"))
    reached = reach(edges, own.select("id"))
    return reached.select("id").distinct().join(own, "id", "left").select(F.col("id").alias("_id"), F.coalesce("reason", F.lit(STALE_PARENT)).alias("_reason"))


def mark_stale(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """Nodes with ``is_stale`` and ``stale_reason`` set by (_id, _reason)."""
    joined = nodes.join(marked, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return joined.select(*[
        (hit | F.col("is_stale")).alias(c) if c == "is_stale" else F.when(hit, F.col("_reason")).otherwise(F.col("stale_reason")).alias(c) if c == "stale_reason" else F.col(c)
        for c in nodes.columns
    ])


def cascade_counts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(n_invalidated, n_descendants): all distinct nodes, and those that aren't starts."""
    reached = reach(edges, starts.select("id").distinct())
    return reached.agg(F.count_distinct("id").alias("n_invalidated"), F.count_if(F.col("depth") > 0).alias("n_descendants"))


def invalidate_sources(nodes: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """All roots of changed sources (source_id, reason) and what derives from them go stale."""
    roots = nodes.filter("node_type = 'ROOT'").join(changed, "source_id").select("id", "reason")
    return cascade(nodes, edges, roots)


def collect_garbage(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that survive, and the removed ids.

    A stale node survives just if some path from it leads to a fresh node, so the survivors are
    the fresh nodes and all their ancestors: one upward search instead of deleting leaf by leaf.
    """
    kept = reach(edges, nodes.filter("not is_stale").select("id"), down=False).select(F.col("id").alias("_kept")).distinct()
    kept = stage(kept, "kept")
    left = nodes.join(kept, F.col("id") == F.col("_kept"), "left_semi")
    links = edges.join(kept, F.col("child_id") == F.col("_kept"), "left_semi").join(kept, F.col("parent_id") == F.col("_kept"), "left_semi")
    return left, links, nodes.join(kept, F.col("id") == F.col("_kept"), "left_anti").select("id")


def obsolete(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stale nodes that are nobody's parent: what one round of deletion takes."""
    return nodes.filter("is_stale").join(edges, F.col("id") == F.col("parent_id"), "left_anti")


def orphan_sources(sources: DataFrame, nodes: DataFrame) -> DataFrame:
    return sources.join(nodes.select(F.col("source_id").alias("_s")), F.col("source_id") == F.col("_s"), "left_anti")


def is_acyclic(edges: DataFrame) -> DataFrame:
    """One row (acyclic)."""
    return strong_components(edges).agg((F.count("*") == 0).alias("acyclic"))


def on_cycles(edges: DataFrame, new: DataFrame) -> DataFrame:
    """The distinct new edges (parent_id, child_id) whose ends are in one strong component of old and new edges: those on a cycle."""
    every = edges.select("parent_id", "child_id").unionByName(new.select("parent_id", "child_id")).distinct()
    known = stage(strong_components(every), "known")
    side = lambda p: known.select(F.col("id").alias(f"_{p}"), F.col("component").alias(f"c{p}"))
    own = new.select("parent_id", "child_id").distinct()
    return own.join(side("p"), F.col("parent_id") == F.col("_p")).join(side("c"), F.col("child_id") == F.col("_c")).filter("cp = cc").select("parent_id", "child_id")


def reject_cycles(edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New edges that may join, and those on a cycle of old and new edges, self-loops included. ``operators.order`` does it over a part of the graph."""
    refused = stage(on_cycles(edges, new), "cycles")
    return new.join(refused, ["parent_id", "child_id"], "left_anti"), new.join(refused, ["parent_id", "child_id"], "left_semi")


def lineage(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(root, id, depth, step, parents, ...) of each requested id and all its ancestors that exist; parents in order of id."""
    from pyspark.sql import Window

    asked = ids.select(F.col("id").alias("root"), "id")
    reached = stage(reach(edges, asked, down=False), "reached")
    known = reached.join(nodes.withColumnRenamed("id", "_n"), F.col("id") == F.col("_n")).drop("_n")
    links = edges.join(reached.select(F.col("id").alias("_i")), F.col("child_id") == F.col("_i"), "left_semi")  # most edges lead to other nodes
    parents = links.groupBy(F.col("child_id").alias("_c")).agg(F.array_sort(F.collect_set("parent_id")).alias("parents"))
    steps = known.join(parents, F.col("id") == F.col("_c"), "left").drop("_c").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))
    return steps.withColumn("step", F.row_number().over(Window.partitionBy("root").orderBy("depth", "id")))


def ancestor_counts(edges: DataFrame, ids: DataFrame) -> DataFrame:
    reached = reach(edges, ids.select(F.col("id").alias("root"), "id"), down=False)
    return reached.groupBy("root").agg((F.count("*") - 1).alias("n_ancestors"))


def operands(edges: DataFrame, order: Column | str = "edge_id") -> DataFrame:
    """Edges with the 0-based place of the parent among its child's operands."""
    from pyspark.sql import Window

    return edges.withColumn("operand", F.row_number().over(Window.partitionBy("child_id").orderBy(order)) - 1)


def children(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node with its outgoing edges; nulls where it has none."""
    return nodes.join(edges.select("edge_id", "parent_id", "child_id", "operation", "expression"), F.col("id") == F.col("parent_id"), "left")
