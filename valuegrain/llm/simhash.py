"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most three bits just if some value lies within one bit of the one
and two bits of the other. So every fingerprint emits all values within one bit (its centres) and
all within two (its probes), both are shuffled on the value, and a probe links to the smallest
fingerprint that has the value as a centre. That link is true by the triangle inequality, is
checked again, and suffices for components: the members of a value all meet at that fingerprint,
so no group is ever expanded into pairs.

Exact copies share one fingerprint and travel as one row. Before the balls, fingerprints that no
other can be near are set aside: of seven blocks at least four agree in any two fingerprints that
differ in three bits, so those alone in all their thirty-five block keys have no link.
Components come from alternating star contraction over the links, one small table a round.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; repeated
rows and ties share a component; a null key counts in no minimum of ``judge``; an empty table gives
an empty result; ``judge`` reads key and text only. ``first_of_group`` keeps all columns and just one
row of each component, whose key may be null or that of another component's row too.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C

SHINGLE, SEED, BITS, RADIUS = 3, 42, 64, 3
BLOCKS, AGREE = 7, 4
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str | None) -> int:
    """The 64 bits as a signed number."""
    words = C.utf8_lower(text).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        starts = [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        raw = np.array(hashes[at : at + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """Carried columns and the fingerprint; one narrow pass."""
    return C.map_texts(docs, text_col, [(name, T.LongType())], lambda: lambda texts: [[fingerprint(t) for t in texts]])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def _masks(bits: int) -> list[int]:
    """All values with so many bits set."""
    return [_signed(sum(1 << b for b in own)) for own in combinations(range(BITS), bits)]


def _each(fp: str, masks: list[int]) -> Column:
    """The fingerprint with each mask's bits flipped."""
    return F.explode(F.transform(F.lit(masks), lambda m: F.col(fp).bitwiseXOR(m)))


def candidates(fps: DataFrame) -> DataFrame:
    """Fingerprints that share at least four of seven blocks with another one."""
    edges = [round(BITS * i / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(BLOCKS)]
    masks = [_signed(sum(own)) for own in combinations(blocks, AGREE)]
    keys = fps.select("fp", F.posexplode(F.transform(F.lit(masks), lambda m: F.col("fp").bitwiseAND(m))).alias("mask", "part"))
    several = C.stage(keys.groupBy("mask", "part").agg(F.count("*").alias("n")).filter("n > 1").select("mask", "part"), "blocks")
    return keys.join(several, ["mask", "part"], "left_semi").select("fp").distinct()


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a > b: links that connect just the fingerprints at most three bits apart."""
    near = C.stage(candidates(fps), "near")
    within_one, at_two = [0, *_masks(1)], _masks(2)
    centres = C.stage(near.select("fp", _each("fp", within_one).alias("value")).groupBy("value").agg(F.min("fp").alias("centre")), "centres")
    probes = near.select("fp", _each("fp", within_one + at_two).alias("value"))
    # a merge join: the size of the probes, two thousand to a fingerprint, can't be told from the table they come from
    met = probes.join(centres.hint("merge"), "value").filter(F.col("fp") != F.col("centre")).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= RADIUS)
    return met.select(F.greatest("fp", "centre").alias("a"), F.least("fp", "centre").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by alternating star contraction."""
    edges = C.stage(edges, "edges")
    done = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = C.stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large")
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = C.stage(large, "stars")
        low = C.stage(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        moved = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = C.stage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for old in (edges, least, large, low):
            C.drop_stage(old)
        edges = nxt
        if state == done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        done = state


def groups(rows: DataFrame, key: str | Column) -> DataFrame:
    """(fp, component): the smallest key of each fingerprint's component. ``rows`` has what makes the key, and fp, staged."""
    fps = C.stage(rows.groupBy("fp").agg(F.min(key).alias("first")), "fps")
    roots = components(links(fps.select("fp")))
    own = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    own = C.stage(own, "roots")
    least = C.stage(own.groupBy("root").agg(F.min("first").alias("component")), "least")
    return C.stage(own.join(least, "root").select("fp", "component"), "groups")


def judge(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for each row."""
    found = with_fingerprint(docs.select(key, text_col), text_col)
    rows = C.stage(found.select(*C.unpack(found, key), "fp"), "fingerprints")
    known = groups(rows, key).withColumnRenamed("fp", "_fp")
    done = rows.join(known, F.col("fp") == F.col("_fp"))
    return done.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def first_of_group(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, all columns kept: the smallest by key (nulls last), fingerprint, text hash and row number.

    Texts meet the numbers of the rows that go, which are fewer than those that stay: while Spark finds them small enough
    to be sent to every task, no text is shuffled; beyond that texts and numbers are joined by a shuffle.
    """
    numbered = C.stage(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    text = F.col(f"doc.`{text_col}`")
    own = numbered.select(F.col(f"doc.`{key}`").alias("key"), F.xxhash64(text).alias("hash"), "row", text.alias("text"))
    found = C.map_texts(own, "text", [("fp", T.LongType())], lambda: lambda texts: [[fingerprint(t) for t in texts]], carry=["key", "hash", "row"])
    rows = C.stage(found.select(*C.unpack(found, "key", "hash", "row"), "fp"), "fingerprints")
    place = F.struct(F.col("key").isNull().alias("last"), "key", "fp", "hash", "row")
    kept = C.stage(groups(rows, place).select(F.col("component.row").alias("row")).distinct(), "kept")
    gone = C.stage(rows.select("row").join(kept, "row", "left_anti"), "gone")
    return numbered.join(gone, "row", "left_anti").select("doc.*")
