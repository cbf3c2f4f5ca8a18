"""Deep graphs: pointers followed by doubling, shortest depths over what no pointer explains, and strong components.

A node with one parent is as deep as that parent and one more, so trees and chains of any length need no search: their
pointers are followed in as many joins as the length has binary digits, and only edges into the other nodes are left. Links
that run together then are one, so what is left is contracted again, as long as it shrinks. Nothing makes pairs: every table
here has at most a row for each node or edge (or for each start and what it reaches).

What is left after that is searched level by level, or, once it has at most ``CORE`` edges, in one go in the tasks that
have the starts; the results are the same.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.sources.staging import drop_stage, stage

#: Edges that one task searches alone: some ten MB.
CORE = 100_000
#: Part of the links that a round must take away to be followed by another one.
SHRINK = 0.1


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Climbed(NamedTuple):
    """``settled`` and ``looping``: (id, up, off, least); ``jumps``: (id, up) with ``up`` 1, 2, 4, ... pointers away, not beyond the end."""

    settled: DataFrame
    looping: DataFrame
    jumps: list[DataFrame]


def climb(pointers: DataFrame) -> Climbed:
    """Pointers (id, up) or (id, up, off), one for each id, followed to their ends.

    Settled ones point to an ``up`` without a pointer, ``off`` steps away. Those that never end are on a loop or lead to one;
    what they point to then are the loops' nodes. ``least`` is the smallest id from the node on, ``up`` left out unless it is on the loop.

    A turn that settles none settles none later on. Then all that is left points to loops once a turn leaves as many nodes
    pointed to, and if it lowers no ``least`` either, each is its whole loop's; so loops take turns by their length, not by their number.
    """
    off = F.col("off") if "off" in pointers.columns else F.lit(1)
    current = stage(pointers.select("id", "up", off.cast("long").alias("off"), F.col("id").alias("least"), F.lit(False).alias("final")), "pointers")
    settled, jumps = [current.limit(0).drop("final")], []
    left, aims = current.count(), None
    for _ in range(left.bit_length() + 1):
        jumps.append(current.select("id", "up"))
        every = union([s.withColumn("final", F.lit(True)) for s in settled] + [current.select("id", "up", "off", "least", "final")])
        further = every.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("off").alias("_off"), F.col("least").alias("_least"), F.col("final").alias("_final"))
        met = current.join(further, F.col("up") == F.col("_id"), "left")
        moved = stage(met.select("id", F.coalesce("_up", "up").alias("up"), (F.col("off") + F.coalesce("_off", F.lit(0))).alias("off"), F.least("least", "_least").alias("least"), F.coalesce("_final", F.lit(True)).alias("final"), F.coalesce(F.col("_least") < F.col("least"), F.lit(False)).alias("fell")), "pointers")
        settled.append(moved.filter("final").drop("final", "fell"))
        current = moved.filter("not final")
        before, (left, fell) = left, current.agg(F.count("*"), F.count_if("fell")).first()
        if not left:
            break
        if left == before:
            known, aims = aims, current.select("up").distinct().count()
            if aims == known and not fell:
                break
    current = current.drop("fell") if "fell" in current.columns else current
    return Climbed(union(settled), current.drop("final"), jumps)


def _walk(edges: pd.DataFrame, seeds: pd.DataFrame) -> dict[str, int]:
    """Smallest depth of each node from the seeds (id, depth) over edges (a, b, w)."""
    out = defaultdict(list)
    for a, b, w in zip(edges["a"], edges["b"], edges["w"], strict=True):
        out[a].append((b, w))
    best: dict[str, int] = {}
    heap = list(zip(seeds["depth"], seeds["id"], strict=True))
    heapq.heapify(heap)
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for y, w in out[x]:
                if y not in best:
                    heapq.heappush(heap, (d + w, y))
    return best


def shortest(links: DataFrame, seeds: DataFrame, core: int | None = None) -> DataFrame:
    """(root, id, depth): smallest depths over links (a, b, w) from seeds (root, id, depth), which are among the result."""
    links = stage(links.groupBy("a", "b").agg(F.min("w").alias("w")), "links")
    if links.count() <= (CORE if core is None else core):
        known = links.sparkSession.sparkContext.broadcast(links.toPandas())

        def walk(own: pd.DataFrame) -> pd.DataFrame:
            best = _walk(known.value, own)
            return pd.DataFrame({"root": own["root"].iloc[0], "id": list(best), "depth": list(best.values())})

        leading = seeds.join(links.select(F.col("a").alias("_a")).distinct(), F.col("id") == F.col("_a"), "left_semi")
        found = leading.groupBy("root").applyInPandas(walk, "root string, id string, depth long")
        return stage(seeds.unionByName(found).groupBy("root", "id").agg(F.min("depth").alias("depth")), "depths")
    best = frontier = stage(seeds.groupBy("root", "id").agg(F.min("depth").alias("depth")), "depths")
    while True:
        met = frontier.join(links, F.col("id") == F.col("a")).groupBy("root", F.col("b").alias("id")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        seen = best.select(F.col("root").alias("_r"), F.col("id").alias("_i"), F.col("depth").alias("_d"))
        frontier = stage(met.join(seen, F.col("root").eqNullSafe(F.col("_r")) & (F.col("id") == F.col("_i")), "left").filter("_d is null or depth < _d").select("root", "id", "depth"), "frontier")
        if frontier.isEmpty():
            return best
        best = stage(best.unionByName(frontier).groupBy("root", "id").agg(F.min("depth").alias("depth")), "depths")


def _single(links: DataFrame) -> DataFrame:
    """(id, up, off) of nodes with one link (a, b, w) into them."""
    return links.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("n"), F.min("a").alias("up"), F.min("w").alias("off")).filter("n = 1").drop("n")


def deep_reach(steps: DataFrame, frontier: DataFrame, core: int | None = None) -> DataFrame:
    """(root, id, depth) of all that ``frontier`` (root, id, depth) reaches over steps (_near, _far), itself included; smallest depths."""
    anchors = frontier.select(F.col("id").alias("_start")).distinct()
    links = stage(steps.filter("_near <> _far").select(F.col("_near").alias("a"), F.col("_far").alias("b"), F.lit(1).cast("long").alias("w")).distinct(), "links")
    left, rounds = links.count(), []
    while left:
        before = left
        pointers = stage(_single(links).join(anchors, F.col("id") == F.col("_start"), "left_anti"), "single")
        trees = stage(climb(pointers).settled.select(F.col("id").alias("_id"), "up", "off"), "trees")  # what loops or hangs on a loop has no way in
        into = links.join(pointers.select(F.col("id").alias("_p")), F.col("b") == F.col("_p"), "left_anti")
        moved = into.join(trees, F.col("a") == F.col("_id"), "left").select(F.coalesce("up", "a").alias("a"), "b", (F.coalesce("off", F.lit(0)) + F.col("w")).alias("w"))
        links = stage(moved.filter("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")), "links")
        entered = links.select(F.col("b").alias("_e")).unionByName(anchors.select(F.col("_start").alias("_e"))).distinct()
        links = stage(links.join(entered, F.col("a") == F.col("_e"), "left_semi"), "links")
        rounds.append(trees)
        left = links.count()
        if left <= (CORE if core is None else core) or left > before * (1 - SHRINK):
            break
    found = shortest(links, frontier.select("root", "id", F.col("depth").cast("long").alias("depth")), core)
    for trees in reversed(rounds):
        below = found.join(trees, F.col("id") == F.col("up")).select("root", F.col("_id").alias("id"), (F.col("depth") + F.col("off")).alias("depth"))
        found = stage(found.unionByName(below), "reached")
    return found


def _tarjan(edges: pd.DataFrame) -> list[tuple[str, str]]:
    """(id, component) of the nodes of components of two nodes or more; a component is named by its smallest id."""
    out = defaultdict(list)
    for a, b in zip(edges["a"], edges["b"], strict=True):
        out[a].append(b)
    index, low, on, stack, found = {}, {}, set(), [], []
    for start in list(out):
        if start in index:
            continue
        todo = [(start, iter(out[start]))]
        index[start] = low[start] = len(index)
        stack.append(start)
        on.add(start)
        while todo:
            x, rest = todo[-1]
            y = next((y for y in rest if y not in index or y in on), None)
            if y is None:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[x])
                if low[x] == index[x]:
                    own = []
                    while not own or own[-1] != x:
                        own.append(stack.pop())
                    on.difference_update(own)
                    if len(own) > 1:
                        found += [(n, min(own)) for n in own]
            elif y in index:
                low[x] = min(low[x], index[y])
            else:
                index[y] = low[y] = len(index)
                stack.append(y)
                on.add(y)
                todo.append((y, iter(out.get(y, ()))))
    return found


def _coloured(links: DataFrame, core: int) -> DataFrame:
    """(id, component) of links (a, b): what lies on no cycle is trimmed, the rest coloured.

    A colour is the largest id that reaches a node; what reaches that one within its colour is its component. Each turn
    finds a component of every colour, and goes on without their nodes.
    """
    done = [stage(links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0), "components")]
    while True:
        size = links.count()
        if size <= core:
            rows = _tarjan(links.toPandas())
            return union(done + ([links.sparkSession.createDataFrame(rows, "id string, component string")] if rows else []))
        inner = links.join(links.select(F.col("b").alias("_b")).distinct(), F.col("a") == F.col("_b"), "left_semi")
        inner = stage(inner.join(links.select(F.col("a").alias("_a")).distinct(), F.col("b") == F.col("_a"), "left_semi"), "links")
        if inner.count() < size:
            links = inner
            continue
        colours = stage(links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct().withColumn("colour", F.col("id")), "colours")
        while True:
            sent = links.join(colours, F.col("a") == F.col("id")).select(F.col("b").alias("id"), "colour")
            nxt = stage(colours.unionByName(sent).groupBy("id").agg(F.max("colour").alias("colour")), "colours")
            same = nxt.join(colours.select(F.col("id").alias("_i"), F.col("colour").alias("_c")), (F.col("id") == F.col("_i")) & (F.col("colour") == F.col("_c")), "left_anti").isEmpty()
            drop_stage(colours)
            colours = nxt
            if same:
                break
        side = lambda p: colours.select(F.col("id").alias(f"_{p}"), F.col("colour").alias(f"c{p}"))
        inside = links.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b")).filter("ca = cb").select(F.col("b").alias("_near"), F.col("a").alias("_far"))
        own = deep_reach(stage(inside, "inside"), colours.filter("id = colour").select(F.lit(None).cast("string").alias("root"), "id", F.lit(0).alias("depth")))
        members = own.select("id").distinct().join(colours.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).select("id", "colour")
        found = stage(members.groupBy(F.col("colour").alias("_c")).agg(F.min("id").alias("component"), F.count("*").alias("n")).join(members, F.col("_c") == F.col("colour")).select("id", "component", "n"), "components")
        done.append(found.filter("n > 1").select("id", "component"))
        gone = found.select(F.col("id").alias("_g"))
        links = stage(links.join(gone, F.col("a") == F.col("_g"), "left_anti").join(gone, F.col("b") == F.col("_g"), "left_anti"), "links")


class _Round(NamedTuple):
    """What a round of contraction took away: ``trees`` (_id, up), their ``jumps``, ``cross`` (a, b, top): links into other nodes and what their near ends became, and ``rings`` (id, component): loops of pointers."""

    trees: DataFrame
    jumps: list[DataFrame]
    cross: DataFrame
    rings: DataFrame


def _trimmed(links: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Links (a, b) without those from a node that none leads to, or to a node that leads nowhere, as long as a quarter goes in a pass."""
    while size:
        inner = links.join(links.select(F.col("b").alias("_b")).distinct(), F.col("a") == F.col("_b"), "left_semi")
        inner = stage(inner.join(links.select(F.col("a").alias("_a")).distinct(), F.col("b") == F.col("_a"), "left_semi"), "links")
        before, size, links = size, inner.count(), inner
        if size > before * 0.75:
            break
    return links, size


def _marked(good: DataFrame, own: _Round) -> DataFrame:
    """(id, up) of the nodes (id) and all that lie between them and the ends of their trees."""
    marks = stage(good.select("id").distinct(), "marks")
    for jump in own.jumps:
        above = marks.join(jump.withColumnRenamed("id", "_j"), F.col("id") == F.col("_j")).select(F.col("up").alias("id"))
        marks = stage(marks.unionByName(above).distinct(), "marks")
    return marks.join(own.trees, F.col("id") == F.col("_id")).select("id", "up")


def _undone(named: DataFrame, own: _Round) -> DataFrame:
    """(id, component) before a round from that after it.

    A node of a tree is in the component of the tree's end just if it leads back there: if it, or a node below it in the tree,
    has a link to that end or into its component.
    """
    side = lambda p: named.select(F.col("id").alias(f"_{p}"), F.col("component").alias(f"c{p}"))
    inner = own.cross.filter("a <> top").join(side("t"), F.col("top") == F.col("_t"), "left").join(side("b"), F.col("b") == F.col("_b"), "left")
    marked = stage(_marked(inner.filter("top = b or ct = cb").select(F.col("a").alias("id")), own), "marked")
    ends = marked.select("up").distinct().join(side("e"), F.col("up") == F.col("_e"), "left").select(F.col("up").alias("_end"), F.coalesce("ce", "up").alias("component"), F.col("_e").isNull().alias("_new"))
    ends = stage(ends, "ends")
    more = marked.join(ends, F.col("up") == F.col("_end")).select("id", "component")
    return stage(union([named, more, ends.filter("_new").select(F.col("_end").alias("id"), "component"), own.rings]), "components")


def strong_components(edges: DataFrame, core: int | None = None) -> DataFrame:
    """(id, component) of the nodes that lie on cycles, self-loops included; a component's name is its smallest id.

    Every cycle through a node with one parent runs through that parent, so such nodes become one with the ends of their
    trees; then those with one child, in turn, as long as the graph shrinks. Graphs of nested loops come down to nothing.
    Going back, a node of a tree joins the component of the tree's end if it leads there.
    """
    most = CORE if core is None else core
    every = stage(edges.select(F.col("parent_id").alias("a"), F.col("child_id").alias("b")).distinct(), "every")
    links = every.filter("a <> b")
    links, size = _trimmed(links, links.count())
    rounds, idle = [], 0
    while size > most and idle < 2:
        before = size
        pointers = stage(_single(links.withColumn("w", F.lit(1))).drop("off"), "single")
        climbed = climb(pointers)
        trees = stage(climbed.settled.select(F.col("id").alias("_id"), "up"), "trees")
        loops = climbed.looping.select(F.col("up").alias("_l")).distinct()
        rings = stage(climbed.looping.join(loops, F.col("id") == F.col("_l"), "left_semi").select("id", F.col("least").alias("component")), "rings")
        into = links.join(pointers.select(F.col("id").alias("_p")), F.col("b") == F.col("_p"), "left_anti")
        into = into.join(climbed.looping.select(F.col("id").alias("_l")), F.col("a") == F.col("_l"), "left_anti")  # nothing leads back to a loop of pointers
        cross = stage(into.join(trees, F.col("a") == F.col("_id"), "left").select("a", "b", F.coalesce("up", "a").alias("top")), "cross")
        rounds.append(_Round(trees, climbed.jumps, cross, rings))
        turned = stage(cross.filter("top <> b").select(F.col("b").alias("a"), F.col("top").alias("b")).distinct(), "links")
        links, size = _trimmed(turned, turned.count())
        idle = idle + 1 if size > before * (1 - SHRINK) else 0
    named = stage(_coloured(links, most), "components") if size else every.limit(0).select(F.col("a").alias("id"), F.col("b").alias("component"))
    for own in reversed(rounds):
        named = _undone(named, own)
    found = named
    alone = every.filter("a = b").select(F.col("a").alias("id"))
    rough = found.unionByName(alone.join(found.select(F.col("id").alias("_f")), F.col("id") == F.col("_f"), "left_anti").withColumn("component", F.col("id")))
    least = rough.groupBy(F.col("component").alias("_c")).agg(F.min("id").alias("least"))
    return rough.join(least, F.col("component") == F.col("_c")).select("id", F.col("least").alias("component"))
