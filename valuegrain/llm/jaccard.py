"""Exact join of documents by the Jaccard similarity of their word n-grams, as a metric-space join.

A link is a Jaccard distance of at most eps = 1 - per_cent / 100. Equal sets are one node. Three steps, each exact:

1. Nested pivots. In Jaccard space nearly all texts lie at distance one from any text, so texts make no useful first pivots.
   The first pivots are the upper sets of an order of all shingles: the share of x that lies below shingle s differs between x
   and y by at most their Jaccard distance. A document's home is the pivot of its lowest shingle, where that share is zero; the
   triangle inequality's window replicates it to the pivots of its own shingles where the share is at most eps. Two linked
   documents meet at their lowest common shingle. Shingles that many documents hold go last, so they open no crowded regions.
2. Pivots of sizes and counts. A region of more than ``REGION`` nodes is cut into rings by size, the distance from the empty
   set, first. Each node carries the counts of its shingles in bins; the Jaccard distance of counts is a metric and never larger
   than that of the sets. A larger ring chooses ``PIVOTS`` of its nodes; each node goes to its nearest one's cell and, by the
   triangle inequality, to each cell whose pivot is at most 2 eps farther. Cells are regions again, until they are small; a
   region that no pivot separates is compared in tiles of bounded size.
3. Small regions compare counts; only pairs that are near enough by them, and not known to be connected, meet with their sets.
   A pair whose lowest shingles tell that it meets in a lower region is left to that one.

Before step 1 nodes that share a least hash meet a few of them, which links most copies; regions whose nodes are all
connected are dropped. Components are the result, so a group of copies isn't expanded into pairs. What remains quadratic is a
group of texts just too far from each other: nothing but their sets tells that, so each two of them are compared.

Shingles are compared by 64-bit digests. The counts that set the order cover all documents, in a table of ``HEAT`` bins; any
order is right. Sets are sent only for candidates: a bitmap of a bounded size says which texts to look at again.

Defined cases: a null text or one without words has an empty set, is linked with nothing and is its own component (of its key,
null for a null key); fewer words than a shingle are one shingle; repeated rows share a component; a null key counts in no
minimum; an empty table gives an empty result; other columns aren't read. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C
from valuegrain.llm.simhash import components

SHINGLE, PER_CENT = 3, 90
#: Odd factors that make orders of hashes; bins of counts at least (more for larger sets); bins of the order.
FACTORS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SKETCH, HEAT = 64, 1 << 16
#: Shingles for each bin of counts, at most; heads that the nodes with a common least hash meet.
FILL, HEADS = 4, 4
#: Lowest shingles of a window that a sketch has.
FIRST = 12
#: Nodes of a region that one task compares; pivots of a larger one; candidates for pivots; share of a region's nodes above which a cell didn't shrink.
REGION, PIVOTS, DRAWS, STUCK = 256, 16, 64, 0.75
#: Bits of the bitmap of texts to look at again.
BITMAP = 1 << 27


def digests(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit digests of a text's shingles in order, repeats included: words' digests, mixed."""
    words = C.utf8_lower(text).split()
    digest = xxhash.xxh3_64_intdigest
    if len(words) < size:
        return np.array([digest(b" ".join(words))] if words else [], np.uint64)
    own = np.array([digest(w) for w in words], np.uint64)
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = (out + own[i : i + len(out)]) * np.uint64(FACTORS[1])
        out ^= out >> np.uint64(29)
    return out


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct digests."""
    return np.unique(digests(text, size))


def _bin(own: np.ndarray) -> np.ndarray:
    return (own & np.uint64(HEAT - 1)).astype(np.int64)


def heat(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Shingles in each bin, over all documents, repeats included; at most ``HEAT`` rows leave a task and reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(HEAT, np.int64)
        for batch in batches:
            found = [digests(text, size) for text in batch.column(0).to_pylist()]
            if found:
                total += np.bincount(_bin(np.concatenate(found)), minlength=HEAT)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bin", "n"])

    out = np.zeros(HEAT, np.int64)
    for r in docs.select(F.col(f"`{text_col}`")).mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def window_size(n: int, per_cent: int) -> int:
    """Shingles from the lowest on below which at most a share eps of n lies."""
    return n + 1 - -(-per_cent * n // 100)


FIELDS = [("a", T.LongType()), ("b", T.LongType()), ("hash", T.LongType()), ("n", T.IntegerType()), ("least", T.ArrayType(T.LongType())), ("window", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]


def sketch_of(own: np.ndarray, low: np.ndarray) -> bytes:
    """The first ``FIRST`` shingles of the window, zeros where it is shorter, and counts of all in bins by their leading bits: a power of two, in proportion to the set."""
    first = np.zeros(FIRST, "<u8")
    first[: min(FIRST, len(low))] = low[:FIRST]
    bits = max(SKETCH.bit_length() - 1, (len(own) // FILL).bit_length())
    while True:
        counts = np.bincount((own >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 1 << 16:
            return first.tobytes() + counts.astype("<u2").tobytes()
        bits += 1


def _counts(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, "<u2", offset=8 * FIRST)


def _folded(counts: list[np.ndarray], bins: int) -> np.ndarray:
    """Counts, a row each, in so many bins."""
    return np.stack([c.reshape(bins, -1).sum(1, dtype=np.int32) for c in counts])


def _bins(counts: list[np.ndarray]) -> int:
    return min(len(c) for c in counts)


def _identity(own: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(own.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _text_hash(text: str | None) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(C.utf8(text)), "big", signed=True)


def with_sets(docs: DataFrame, key: str, text_col: str, size: int, per_cent: int) -> DataFrame:
    """(_key, and ``FIELDS``): the set's digest, text's hash, size, least hashes, window of lowest shingles and counts."""
    bins = docs.sparkSession.sparkContext.broadcast(heat(docs, text_col, size))

    def make():
        hot = bins.value

        def one(text):
            own = shingles(text, size)
            if not len(own):
                return 0, 0, 0, 0, [], [], b""
            least = [int((own * np.uint64(f)).min().view(np.int64)) for f in FACTORS]
            low = own[np.lexsort((own, hot[_bin(own)]))[: window_size(len(own), per_cent)]]
            return *_identity(own), _text_hash(text), len(own), least, low.view(np.int64), sketch_of(own, low)

        return lambda texts: list(zip(*map(one, texts), strict=True))

    found = C.map_texts(docs.select(F.col(key).alias("_key"), F.col(text_col).alias("_text")), "_text", FIELDS, make, carry=["_key"])
    return found.select(*C.unpack(found, "_key"), *[n for n, _ in FIELDS])


def _similar(common: Column, n: Column, m: Column, per_cent: int) -> Column:
    return common * 100 >= (n + m - common) * per_cent


def _near(pairs: DataFrame, nodes: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of nodes that are near enough by sizes and counts."""
    side = lambda p: nodes.select(F.col("node").alias(f"_{p}"), F.col("n").alias(f"n{p}"), F.col("sketch").alias(f"s{p}"))
    met = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    sized = met.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent).select("a", "b", "na", "nb", "sa", "sb")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
                each = [[_counts(x) for x in pair] for pair in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
                low = np.array([np.minimum(*_folded(pair, _bins(pair))).sum() for pair in each])
                yield batch.select(["a", "b"]).filter(pa.array(100 * low >= per_cent * (n + m - low)))

    return sized.mapInArrow(near, "a long, b long")


def homes(nodes: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of nodes with a common least hash: each with the first of each of ``HEADS`` groups of them, as one alone may be an odd copy."""
    own = nodes.select("node", "n", F.posexplode("least").alias("order", "hash"))
    drawn = F.pmod(F.xxhash64(F.lit("head"), "node"), F.lit(HEADS))
    first = own.groupBy("order", "hash", drawn.alias("draw")).agg(F.min(F.struct("node", "n")).alias("first"), F.count("*").alias("held"))
    heads = first.groupBy("order", "hash").agg(F.collect_list("first").alias("heads"), F.sum("held").alias("held")).filter("held > 1")  # at most HEADS in each
    met = own.join(heads.select("order", "hash", "heads"), ["order", "hash"]).select("node", "n", F.explode("heads").alias("first")).filter(F.col("node") != F.col("first.node"))
    sized = met.filter(F.least("n", "first.n") * 100 >= F.greatest("n", "first.n") * per_cent)
    return sized.select(F.least("node", "first.node").alias("a"), F.greatest("node", "first.node").alias("b")).distinct()


def sets_of(docs: DataFrame, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """(node, own): the sets of the wanted nodes (node, a, b, hash). Only texts whose bit is set are cut again; a batch sends equal sets once."""
    place = F.pmod("hash", F.lit(BITMAP))
    bits = wanted.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, int(pmod(hash, 64)))").alias("bit"))
    words = np.zeros(BITMAP >> 6, np.int64)
    marked = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # no more than the bitmap has words
    words[marked["word"].to_numpy()] = marked["bits"].to_numpy()
    known = docs.sparkSession.sparkContext.broadcast(words.view(np.uint8))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = known.value
        for batch in batches:
            found = {}
            for text in batch.column(0).to_pylist():
                at = _text_hash(text) % BITMAP
                if bitmap[at >> 3] >> (at & 7) & 1:
                    own = shingles(text, size)
                    if len(own):
                        found[_identity(own)] = own.view(np.int64)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["a", "b", "own"])

    sent = docs.select(F.col(f"`{text_col}`")).mapInArrow(send, "a long, b long, own array<long>")
    return sent.join(wanted.select("node", "a", "b"), ["a", "b"]).groupBy("node").agg(F.first("own").alias("own"))


def verified(docs: DataFrame, text_col: str, pairs: DataFrame, nodes: DataFrame, size: int, per_cent: int) -> DataFrame:
    """The pairs (a, b) that are links, by their sets."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_n")).distinct()
    wanted = C.stage(nodes.join(ends, F.col("node") == F.col("_n")).select("node", "a", "b", "hash"), "wanted")
    sets = C.stage(sets_of(docs, text_col, wanted, size), "sets")
    side = lambda p: sets.select(F.col("node").alias(f"_{p}"), F.col("own").alias(f"s{p}"))
    met = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    links = C.stage(met.filter(_similar(F.size(F.array_intersect("sa", "sb")), F.size("sa"), F.size("sb"), per_cent)).select("a", "b"), "links")
    C.drop_stage(wanted, sets)
    return links


def roots(links: DataFrame) -> DataFrame:
    """(_n, root) of linked nodes."""
    if links.isEmpty():
        return links.select(F.col("a").alias("_n"), F.col("b").alias("root"))
    return components(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).select(F.col("node").alias("_n"), "root")


def regions(nodes: DataFrame, known: DataFrame, per_cent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rows): regions of the nested pivots with two nodes, and (region, node, root, pos, class) of those with more.

    Connected regions are left out; of those with the same nodes the lowest stays, and in it each node stays only if another has a size near its own.
    """
    own = nodes.select("node", "n", F.posexplode("window").alias("pos", "region"))
    held = C.stage(own.groupBy("region").agg(F.count("*").alias("held"), F.min("node").alias("a"), F.max("node").alias("b")).filter("held > 1"), "held")
    pairs = held.filter("held = 2").select("a", "b").distinct()
    side = lambda p: known.select(F.col("_n").alias(f"_{p}"), F.col("root").alias(f"r{p}"))
    met = pairs.join(side("a"), F.col("a") == F.col("_a"), "left").join(side("b"), F.col("b") == F.col("_b"), "left")
    apart = met.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    crowded = own.join(held.filter("held > 2").select("region"), "region", "left_semi")
    class_of = F.floor(F.log("n") / math.log(100 / per_cent)).cast("int")  # sizes of a link are in the same class or in two next to each other
    rows = C.stage(crowded.join(known, F.col("node") == F.col("_n"), "left").select("region", "node", F.coalesce("root", "node").alias("root"), "pos", class_of.alias("class")), "crowded")
    shape = rows.groupBy("region").agg(
        F.count("*").alias("held"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit(7), F.col("node"))).alias("xor"),
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("pos").alias("first"),
    )
    kept = shape.filter("low < high").groupBy("held", "sum", "xor").agg(F.min_by("region", "first").alias("region")).select("region")
    rows = rows.join(C.stage(kept, "kept"), "region", "left_semi")
    sizes = rows.groupBy("region", "class").agg(F.count("*").alias("n"))
    around = sizes.select("region", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), "n").groupBy("region", "class").agg(F.sum("n").alias("n")).filter("n > 1")
    return apart, rows.join(around.drop("n"), ["region", "class"], "left_semi").select("region", "node", "root", "pos", "class")


def _with_sketches(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return rows.join(nodes.select(F.col("node").alias("_m"), "n", "sketch").hint("merge"), F.col("node") == F.col("_m")).drop("_m")


def _pairs_of(node: np.ndarray, root: np.ndarray, pos: np.ndarray, size: np.ndarray, n: np.ndarray, sketches: list[bytes], per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a region's nodes that aren't connected, are near enough by counts, and don't meet in a lower region for what their sketches say.

    ``size`` is the class of sizes: linked nodes are in one class or in two next to each other.
    """
    firsts, seconds = [node[:0]], [node[:0]]
    for c in np.unique(size):
        own = np.flatnonzero(size == c)
        both = np.concatenate([own, np.flatnonzero(size == c + 1)])
        if len(both) < 2 or (root[both] == root[both[0]]).all():
            continue
        counts = [_counts(sketches[i]) for i in both]
        counts = _folded(counts, _bins(counts))
        lower = np.stack([np.frombuffer(sketches[i], "<u8", FIRST) for i in both])
        lower = np.where(np.arange(FIRST) < pos[both][:, None], lower, 0)  # shingles of the window below the region's
        m, r = n[both], root[both]
        for i in range(len(own)):
            low = np.minimum(counts[i + 1 :], counts[i]).sum(1)
            near = np.flatnonzero((100 * low >= per_cent * (m[i + 1 :] + m[i] - low)) & (r[i + 1 :] != r[i])) + i + 1
            if len(near):
                near = near[~(np.isin(lower[near], lower[i]) & (lower[near] != 0)).any(1)]
                firsts.append(np.full(len(near), node[both[i]]))
                seconds.append(node[both[near]])
    a, b = np.concatenate(firsts), np.concatenate(seconds)
    return np.minimum(a, b), np.maximum(a, b)


def compared(rows: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of each small region's rows (region, node, root, pos, class, n, sketch); a task holds one region and a batch at a time."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(table, cuts):
            own = [*[table[c].to_numpy() for c in ("node", "root", "pos", "class", "n")], table["sketch"].to_pylist()]
            found = [_pairs_of(*[x[i:j] for x in own], per_cent) for i, j in zip([0, *cuts], [*cuts, len(table)])]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        left = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            left = pa.concat_tables([left, table]) if left is not None else table
            region = left["region"].to_numpy()
            cuts = np.flatnonzero(region[1:] != region[:-1]) + 1
            if len(cuts):
                yield whole(left.slice(0, cuts[-1]), cuts[:-1])
                left = left.slice(cuts[-1])
        if left is not None and len(left):
            yield whole(left, [])

    return rows.repartition("region").sortWithinPartitions("region").mapInArrow(compare, "a long, b long")


def _pivots(rows: DataFrame, turn: int) -> DataFrame:
    """(_region, pivots): sketches of ``PIVOTS`` nodes of each region, drawn from ``DRAWS`` groups of its nodes by hash, so that no region is in one place."""
    h = F.xxhash64(F.lit(turn), F.col("node"))
    drawn = rows.groupBy("region", F.pmod(h, F.lit(DRAWS)).alias("draw")).agg(F.min_by("sketch", F.struct(h, "node")).alias("sketch"))
    return drawn.groupBy(F.col("region").alias("_region")).agg(F.slice(F.array_sort(F.collect_list(F.struct("draw", "sketch"))), 1, PIVOTS)["sketch"].alias("pivots"))


def rings(rows: DataFrame) -> DataFrame:
    """The next regions by size, a set's distance from the empty one: each node in the ring of its class and in the one below, so that linked ones share one."""
    each = rows.withColumn("ring", F.explode(F.array(F.col("class") - 1, F.col("class"))))
    return each.select(F.xxhash64(F.lit("ring"), "region", "ring").alias("region"), "node", "root", "pos", "class")


def cells(rows: DataFrame, turn: int, per_cent: int) -> DataFrame:
    """(parent, region, node, root, pos, class) of the next regions: each node in its nearest pivot's cell and in those at most 2 eps farther.

    If x and y are within eps and y's nearest pivot is q, then d(x, q) <= d(y, q) + eps <= d(y, p) + eps <= d(x, p) + 2 eps for x's nearest pivot p.
    """
    slack = 2 * (100 - per_cent) / 100 + 1e-9
    kept = ["region", "node", "root", "pos", "class"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            inside, centres = [], {}
            for sketch, k, region, pivots in zip(batch.column("sketch").to_pylist(), batch.column("n").to_pylist(), batch.column("region").to_pylist(), batch.column("pivots"), strict=True):
                own = _counts(sketch)
                if region not in centres:
                    known = [_counts(x) for x in pivots.values.to_pylist()]
                    centres[region] = _folded(known, _bins(known))
                bins = min(len(own), centres[region].shape[1])
                there = centres[region].reshape(len(centres[region]), bins, -1).sum(2)
                low = np.minimum(there, _folded([own], bins)).sum(1)
                away = 1 - low / (k + there.sum(1) - low)
                inside.append(np.flatnonzero(away <= away.min() + slack))
            at = np.repeat(np.arange(batch.num_rows), [len(i) for i in inside])
            taken = pa.Table.from_batches([batch.select(kept)]).take(pa.array(at)).append_column("cell", pa.array(np.concatenate(inside), pa.int32()))
            yield from taken.combine_chunks().to_batches()

    met = rows.join(_pivots(rows, turn).hint("merge"), F.col("region") == F.col("_region")).select(*kept, "n", "sketch", "pivots")
    found = met.mapInArrow(split, f"{ROWS}, cell int")
    return found.select(F.col("region").alias("parent"), F.xxhash64(F.lit(turn), "region", "cell").alias("region"), *kept[1:])


def tiles(rows: DataFrame, region: int) -> DataFrame:
    """Regions of all pairs of tiles of the regions (with ``held``): for what no pivot separates."""
    count = F.ceil(F.col("held") * 2 / region)
    own = F.pmod(F.xxhash64(F.lit("tile"), F.col("node")), count)
    met = rows.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    return met.select(F.xxhash64("region", F.least("tile", "other"), F.greatest("tile", "other")).alias("region"), "node", "root", "pos", "class")


ROWS = "region long, node long, root long, pos int, class int"


def near_in_regions(rows: DataFrame, nodes: DataFrame, per_cent: int, region: int = REGION) -> DataFrame:
    """(a, b): the near pairs of the regions' rows (region, node, root, pos, class). Sketches join them where they are needed.

    Larger regions are cut into rings, then by pivots until all are small. A region with a cell of more than ``STUCK`` of it is cut into tiles instead.
    """
    found, turn = [], 0
    near = lambda part: found.append(C.stage(compared(_with_sketches(part, nodes), per_cent).distinct(), "near"))
    while True:
        sizes = rows.groupBy("region").agg(F.count("*").alias("held"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high").withColumnRenamed("region", "_r")
        rows = C.stage(rows.join(sizes, F.col("region") == F.col("_r")).drop("_r", "_low", "_high"), "regions")
        near(rows.filter(F.col("held") <= region).drop("held"))
        large = rows.filter(F.col("held") > region)
        if large.isEmpty():
            break
        turn += 1
        if turn == 1:
            rows = C.stage(rings(large), "rings")
            continue
        parts = C.stage(cells(_with_sketches(large, nodes), turn, per_cent), "cells")
        largest = parts.groupBy("parent", "region").count().groupBy(F.col("parent").alias("_p")).agg(F.max("count").alias("largest"))
        stuck = large.select("region", "held").distinct().join(largest, F.col("region") == F.col("_p")).filter(F.col("largest") > F.col("held") * STUCK).select(F.col("region").alias("_s"))
        stuck = C.stage(stuck, "stuck")
        near(tiles(large.join(stuck, F.col("region") == F.col("_s"), "left_semi"), region))
        rows = C.stage(parts.join(stuck, F.col("parent") == F.col("_s"), "left_anti").drop("parent"), "regions")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def join(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = SHINGLE, per_cent: int = PER_CENT, region: int = REGION) -> tuple[DataFrame, DataFrame]:
    """(members, links): (_key, node, n) of each row, node null for an empty set; and links (a, b) of nodes that connect all that are linked.

    Nodes are the distinct sets. ``links`` holds no link whose ends were connected by others already.
    """
    found = C.stage(with_sets(docs, key, text_col, size, per_cent), "sets")
    own = [n for n, _ in FIELDS]
    nodes = found.filter("n > 0").groupBy("a", "b").agg(F.first(F.struct(*own[2:])).alias("own")).select("a", "b", "own.*")
    nodes = C.stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = C.stage(found.select("_key", "a", "b", "n"), "rows")
    C.drop_stage(found)
    first = C.stage(_near(homes(nodes, per_cent), nodes, per_cent), "near")
    links = verified(docs, text_col, first, nodes, size, per_cent)
    known = C.stage(roots(links), "known")
    pairs, crowded = regions(nodes, known, per_cent)
    pairs = C.stage(_near(pairs, nodes, per_cent), "near")
    more = C.stage(pairs.unionByName(near_in_regions(crowded, nodes, per_cent, region)).distinct(), "near")
    links = links.unionByName(verified(docs, text_col, more, nodes, size, per_cent))
    names = nodes.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "node")
    members = rows.join(names, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n") > 0), "left").select("_key", "node", "n")
    return members, links


def judge(docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = SHINGLE, per_cent: int = PER_CENT, region: int = REGION) -> DataFrame:
    """(key, n_shingles, component_id) for each row."""
    members, links = join(docs.select(key, text_col), key, text_col, size, per_cent, region)
    rooted = members.join(roots(links), F.col("node") == F.col("_n"), "left").select("_key", "n", F.coalesce("root", "node").alias("root"))
    rooted = C.stage(rooted, "rooted")
    least = rooted.filter("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("_key").alias("component"))
    done = rooted.join(least, F.col("root") == F.col("_root"), "left")
    return done.select(F.col("_key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("_key")).otherwise(F.col("component")).alias("component_id"))
