"""The trie of conversation prefixes, its subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns. Its digest comes from its turns' digests, chained in blocks of ``BLOCK``
turns and then over the blocks, so a conversation of any length is never in one row or task. Nodes are numbered in the
order of (parent, smallest member), so a node's children have numbers in a row. Every node gives an enter and an exit
arc, each arc knows the next one of the tour from that numbering, the tour is list-ranked, and a node's leaves and savings
are differences of running sums at the places of its two arcs.

Rebuilding: conversation c takes the first h turns of conversation c - c % 5 and then its own after its first h; h is the
crc32 of its id modulo 9. Turns go by turn (nulls first), role, and digest of role and text.

Defined cases: rows without a conversation's id belong to none; null roles and texts are empty; repeated rows are turns
of their own; a conversation without turns after rebuilding ends at the root; without any conversation there is no node;
other columns aren't read. A node's digest of ends streams its members' ids in order, pieces of ``PIECE`` at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.llm import common as C
from valuegrain.llm.order import list_places, numbered, running
from valuegrain.llm.resample import CRC, crc_sql

#: Conversations that share their head's source, the modulus of the head's length, turns of a block, ids of a piece (bits).
FAMILY, HEADS, BLOCK, PIECE_BITS = 5, 9, 64, 12
ROOT = bytearray()


def _digest(data: Column) -> Column:
    """16 bytes."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, t, bytes): a turn's digest and its text's UTF-8 bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    same = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    known = conversations.filter(F.col("conv_id").isNotNull())
    return known.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), _digest(same.cast("binary")).alias("t"), F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): (conv_id, i, t, bytes) of the rebuilt conversations, i from 1; and all (conv_id)."""
    placed = numbered(C.stage(own, "turns"), [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("t").asc()])
    convs = placed.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    convs = C.stage(convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}), "convs")
    lengths = convs.select(F.col("conv_id").alias("_base"), F.col("n").alias("_n"))
    heads = convs.join(lengths, F.col("base") == F.col("_base"), "left").withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0))))
    heads = heads.select(F.col("conv_id").alias("_c"), "start", "h", "taken")
    indexed = placed.join(heads, F.col("conv_id") == F.col("_c")).withColumn("i", F.col("place") - F.col("start") + 1)
    indexed = C.stage(indexed.select("conv_id", "i", "h", "taken", "t", "bytes"), "indexed")
    rest = indexed.filter("i > h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("i"), "t", "bytes")
    lent = indexed.filter((F.col("i") < HEADS) & (F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("_from"), "i", "t", "bytes")
    borrowed = convs.filter("h > 0").select("conv_id", "base", "h").join(lent, F.col("base") == F.col("_from")).filter("i <= h").select("conv_id", "i", "t", "bytes")
    return rest.unionByName(borrowed), convs.select("conv_id")


def chained(items: DataFrame) -> DataFrame:
    """(conv_id, i, bytes, key, parent): digests of the first i and of the first i - 1 of each sequence (conv_id, i, t, bytes)."""
    block = F.shiftright(F.col("i") - 1, BLOCK.bit_length() - 1)
    grouped = items.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "t", "bytes"))).alias("own"))  # at most BLOCK in each
    chain = F.aggregate("own", F.array().cast("array<binary>"), lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x["t"]).otherwise(_digest(F.concat(F.try_element_at(a, F.lit(-1)), x["t"]))))))
    blocks = C.stage(grouped.withColumn("chain", chain), "blocks")
    later = blocks.filter("block > 0")
    none = F.lit(None).cast("binary")
    if later.isEmpty():
        blocks = blocks.withColumn("before", none)
    else:
        full = blocks.filter(F.size("own") == BLOCK)
        ends = full.select("conv_id", (F.col("block") + 1).alias("i"), F.element_at("chain", -1).alias("t"), F.lit(0).cast("long").alias("bytes"))
        before = chained(ends).select(F.col("conv_id").alias("_c"), F.col("i").alias("_i"), F.col("key").alias("before"))
        met = later.join(before, (F.col("conv_id") == F.col("_c")) & (F.col("block") == F.col("_i"))).drop("_c", "_i")
        blocks = blocks.filter("block = 0").withColumn("before", none).unionByName(met)
    whole = lambda s: F.when(F.col("before").isNull(), s).otherwise(_digest(F.concat("before", s)))
    rows = F.transform("own", lambda x, j: F.struct(
        x["i"].alias("i"), x["bytes"].alias("bytes"), whole(F.get("chain", j)).alias("key"),
        F.when(j > 0, whole(F.get("chain", j - 1))).otherwise(F.coalesce("before", F.lit(ROOT))).alias("parent"),
    ))
    return blocks.select("conv_id", F.explode(rows).alias("r")).select("conv_id", "r.*")


def _ends(lasts: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations (key, conv_id) end."""
    placed = numbered(lasts, [F.col("key").asc(), F.col("conv_id").asc()])
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = placed.groupBy("key", F.shiftright("place", PIECE_BITS).alias("piece")).agg(ids.alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, found = [], []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        found.append(state.hexdigest())
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(digests, "key binary, ends_sha256 string")


def tree_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes with numbers, parents and children: (node, key, conv_id, depth, parent_conv_id, n_convs, n_children, saved, first, up, last)."""
    below = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.min("i").alias("depth"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"))
    nodes = C.stage(numbered(C.stage(below.unionByName(root), "nodes"), [F.col("parent").asc_nulls_first(), F.col("conv_id").asc()], "node"), "nodes")
    spans = nodes.filter("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n_children"))
    parents = C.stage(spans.join(nodes.select("key", F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id")), F.col("_p") == F.col("key")).drop("key"), "parents")
    down = nodes.join(parents.select(F.col("_p").alias("_k"), "first", "n_children"), F.col("key") == F.col("_k"), "left")
    both = down.join(parents.select("_p", "up", "parent_conv_id", "last"), F.col("parent") == F.col("_p"), "left")
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    return C.stage(both.select("node", "key", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), saved.alias("saved"), "first", "up", "last"), "tree")


def tour(tree: DataFrame) -> DataFrame:
    """(id, next) of the Euler tour's arcs: a node's enter arc has twice its number, its exit arc one more."""
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    into = F.struct(enter.alias("id"), F.coalesce(F.col("first") * 2, leave).alias("next"))
    out = F.struct(leave.alias("id"), F.when(F.col("node") < F.col("last"), enter + 2).otherwise(F.col("up") * 2 + 1).alias("next"))
    return tree.select(F.explode(F.array(into, out)).alias("a")).select("a.*")


def subtree_sums(tree: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens): sums over the running ones at the exit arc less those before the enter arc."""
    places = C.stage(list_places(tour(tree)), "places")
    worth = tree.select("node", (F.col("n_children") == 0).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    entered = F.col("id") % 2 == 0
    arcs = places.join(worth, F.shiftright("id", 1) == F.col("node"))
    arcs = C.stage(arcs.select("node", "place", entered.alias("entered"), *[F.when(entered, F.col(c)).otherwise(0).alias(c) for c in ("n_leaves", "saved_tokens")]), "arcs")
    own = [F.when(F.col("entered"), F.col(c)).otherwise(0).alias(f"own_{c}") for c in ("n_leaves", "saved_tokens")]
    summed = running(arcs.select("*", *own), "place", ["n_leaves", "saved_tokens"])
    total = lambda c: F.sum(F.when(F.col("entered"), F.col(f"own_{c}") - F.col(c)).otherwise(F.col(c))).alias(c)
    return summed.groupBy(F.col("node").alias("_node")).agg(total("n_leaves"), total("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    items, convs = rebuilt(turns(conversations))
    rows = C.stage(chained(items), "prefixes")
    tree = tree_of(rows, convs)
    sums = subtree_sums(tree)
    lasts = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.max_by("key", "i").alias("key"))
    ends = _ends(C.stage(convs.join(lasts, F.col("conv_id") == F.col("_c"), "left").select(F.coalesce("key", F.lit(ROOT)).alias("key"), "conv_id"), "ends")).withColumnRenamed("key", "_key")
    done = tree.join(sums, F.col("node") == F.col("_node")).join(ends, F.col("key") == F.col("_key"), "left")
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


#: Sequences are lists of structs; a node is a list, its ancestors are the list's beginnings.
ORACLE = f"""
WITH {CRC}, own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(strlen(coalesce(role, '')), ':', role, text))) AS i, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (SELECT c, {crc_sql("CAST(c AS VARCHAR)")} % {HEADS} AS h, c - c % {FAMILY} AS base, n FROM (SELECT c, count(*) AS n FROM own GROUP BY c), tab
), seq AS (
  SELECT convs.c, i, t FROM convs JOIN own ON own.c = convs.base AND i <= h
  UNION ALL SELECT own.c, least(h, coalesce(b.n, 0)) + i - h, t FROM own JOIN convs ON own.c = convs.c LEFT JOIN (SELECT c, n FROM convs) b ON b.c = convs.base WHERE i > h
), whole AS (SELECT convs.c, coalesce(list(t ORDER BY i) FILTER (t IS NOT NULL), []) AS s FROM convs LEFT JOIN seq ON seq.c = convs.c GROUP BY convs.c
), member AS (SELECT c, s, CAST(unnest(range(0, len(s) + 1)) AS BIGINT) AS d FROM whole
), node AS (SELECT list_slice(s, 1, d) AS k, d AS depth, min(c) AS conv_id, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(s) = d) AS ends FROM member GROUP BY k, d
), child AS (SELECT list_slice(k, 1, depth - 1) AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1
), full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[depth].text) END AS saved FROM node LEFT JOIN child USING (k)
), sums AS (
  SELECT list_slice(k, 1, a) AS k, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT k, n_children, saved, unnest(range(0, depth + 1)) AS a FROM full_node) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM full_node f JOIN sums USING (k) LEFT JOIN full_node p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.k = list_slice(f.k, 1, f.depth - 1)
"""
