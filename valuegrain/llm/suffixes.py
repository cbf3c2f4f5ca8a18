"""Suffix-array dedup by a logarithmic family of sparse suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes; the result is exact.

Sparse: a string of ``LENGTH`` bytes is filed under one suffix, the one that starts at the smallest hashed
gram among its first ``SPREAD`` positions. That choice depends on the string alone, so equal strings are filed
at equal offsets, and about one suffix in ``SPREAD / 2`` bytes is kept. Each has a key that orders it (its first eight bytes, then a
fingerprint of the ``DEPTH`` bytes that all its strings share), the range of starts filed there, and a
digest of all bytes that those strings cover.

Family: documents come in batches. A batch's suffixes become a suffix array (a run: the distinct suffixes with their numbers, in
buckets of keys, sorted in each), which is merge-scanned against each existing level for equal keys and then joins the family:
while a level of the same size exists, the two merge into one of twice the size, so a suffix is rewritten a logarithmic number of
times. Levels lie in a folder and outlive the session: a later batch meets what earlier ones left. All have the same buckets, so
scans and merges read them bucket by bucket, in order, and shuffle nothing; only a batch itself is shuffled, counted beforehand.

A text that repeats within itself, such as a run of one letter, has a stretch of suffixes whose strings are those of the
suffix before, moved on by a period. All of them are repeated; the first stands for the stretch and counts twice.

Verdicts: where two suffixes agree in key and digest, all strings filed there are repeated. Where only keys
agree, the ranges of every undecided suffix, and of one suffix for each distinct digest under the same key, are
cut into parts of ``STEP`` starts that are compared in the same way; what is still undecided is digested string
by string (128 bits) and counted. Only texts with suffixes found again are shuffled.

Rows with the same key and text share one identity but count as two occurrences. Defined cases: null is the
empty text; texts of any length are read whole; columns other than key and text are not read; texts under ``LENGTH`` bytes lose nothing; repeated bytes within a text count; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm import common as C
from valuegrain.sources import tables

LENGTH, GRAM, SPREAD = 400, 16, 200
DEPTH = LENGTH - SPREAD + 1
BATCHES = 4
#: Positions that are hashed at once, and bits of a position within them.
BLOCK, PLACE_BITS = 1 << 20, 22
#: Suffixes of one period from which on a text is compared with itself whole, not suffix by suffix.
MANY = 64
#: Starts that are decided together in the second step.
STEP = 16
SUFFIX = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("low", "high", "anchor")], *[T.StructField(n, T.LongType()) for n in ("head", "print", "d1", "d2")]])
#: With the last start of the stretch that a suffix stands for; its own last start if for itself alone.
STRETCH = T.StructType([*SUFFIX.fields, T.StructField("till", T.IntegerType())])
KEY = ["head", "print"]
DIGEST = ["d1", "d2"]
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM, spread: int = SPREAD) -> np.ndarray:
    """For each start of a string of ``length`` bytes: where the suffix begins under which it is filed."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    parts = []
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, n, BLOCK):
        starts = min(BLOCK, n - at)
        h = _TABLE[raw[at : at + starts + spread + gram - 2]]
        span = 1
        while span < gram:  # the gram's length is a power of two
            h = h[:-span] * np.uint64(pow(_FACTOR, span, 1 << 64)) + h[span:]
            span *= 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h >>= np.uint64(PLACE_BITS)
        h <<= np.uint64(PLACE_BITS)
        h |= np.arange(len(h), dtype=np.uint64)
        span = 1
        while span * 2 <= spread:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        h = np.minimum(h[:starts], h[spread - span : spread - span + starts])
        parts.append((h & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + at)
    return np.concatenate(parts)


def _entry(data: bytes, low: int, high: int, anchor: int, common: int, length: int) -> tuple[int, ...]:
    """A range of starts: its key is made of the ``common`` bytes from the anchor on, its digest of all bytes that its strings cover."""
    d = xxhash.xxh3_128_digest(data[low : high + length])
    key = xxhash.xxh3_64_intdigest(data[anchor : anchor + common])
    return (low, high, anchor, int.from_bytes(data[anchor : anchor + 8], "big", signed=True), _signed(key), int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True))


def repeats(data: bytes, lows: np.ndarray, highs: np.ndarray, filed: np.ndarray, length: int) -> np.ndarray:
    """Whether the strings of each suffix are those of the one before, moved on by as much as the suffix is."""
    again = np.zeros(len(lows), bool)
    by = np.diff(lows)
    alike = (by == np.diff(highs)) & (by == np.diff(filed))
    raw = np.frombuffer(data, np.uint8)
    for p in np.unique(by[alike]).tolist():
        own = np.flatnonzero(alike & (by == p))
        if len(own) < MANY:
            equal = [data[lows[i] : highs[i] + length] == data[lows[i] + p : highs[i] + p + length] for i in own.tolist()]
        else:
            differing = np.concatenate([[0], np.cumsum(raw[:-p] != raw[p:], dtype=np.int32)])
            equal = differing[highs[own] + length] == differing[lows[own]]
        again[own + 1] = equal
    return again


def suffixes_of(data: bytes, length: int = LENGTH, spread: int = SPREAD, gram: int = GRAM) -> list[tuple[int, ...]]:
    """(first start, last start, anchor, head, fingerprint, digest, last start of the stretch) of each suffix with strings that stands for itself or for a stretch."""
    filed = anchors(data, length, gram, spread)
    if not len(filed):
        return []
    cuts = np.flatnonzero(filed[1:] != filed[:-1]) + 1
    lows, highs = np.concatenate([[0], cuts]), np.concatenate([cuts - 1, [len(filed) - 1]])
    first = np.flatnonzero(~repeats(data, lows, highs, filed[lows], length))
    tills = highs[np.append(first[1:], len(lows)) - 1]
    return [(*_entry(data, low, high, a, length - spread + 1, length), till) for low, high, a, till in zip(lows[first].tolist(), highs[first].tolist(), filed[lows[first]].tolist(), tills.tolist())]


def parts_of(data: bytes, low: int, high: int, anchor: int, length: int = LENGTH) -> list[tuple[int, ...]]:
    """The range of a suffix's starts cut at multiples of ``STEP`` before its anchor; a part's key has what the strings of a whole part share."""
    out = []
    for k in range((anchor - high) // STEP, (anchor - low) // STEP + 1):
        first, last = anchor - k * STEP - STEP + 1, anchor - k * STEP
        out.append(_entry(data, max(low, first), min(high, last), last, length - STEP + 1, length))
    return out


def with_suffixes(docs: DataFrame) -> DataFrame:
    """(key, hash, low, high, anchor, head, print, d1, d2, till) of all texts; one narrow pass."""

    def make():
        def work(texts):
            rows = [suffixes_of(C.utf8(t)) for t in texts]
            offsets = [0]
            for own in rows:
                offsets.append(offsets[-1] + len(own))
            flat = list(zip(*[s for own in rows for s in own])) or [()] * len(STRETCH)
            items = pa.StructArray.from_arrays([pa.array(c, C.to_arrow(f.dataType)) for c, f in zip(flat, STRETCH)], names=STRETCH.names)
            return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)]

        return work

    out = C.map_texts(docs, "_own", [("s", T.ArrayType(STRETCH))], make, carry=["_key", "_hash"])
    return out.select(*C.unpack(out, "_key", "_hash"), F.explode("s").alias("s")).select("_key", "_hash", "s.*")


RUN = "head long, print long, d1 long, d2 long, n long"


class Family:
    """The levels in a folder: distinct (key, digest) with how often, bucketed and sorted by key.

    What the folder's last version names is the family; a batch writes new levels beside it and then the next version.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        self.spark, self.folder = spark, folder
        stored = tables.read_snapshot(spark, f"{folder}/versions", ("levels",))
        rows = stored["levels"].collect() if stored else []  # one for each level
        self.buckets = rows[0]["buckets"] if rows else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.paths: dict[str, str] = {}
        self.levels = {r["level"]: self._known(r["path"]) for r in rows}

    def _name(self, path: str = "") -> str:
        name = f"suffixes_{uuid.uuid4().hex}"
        self.paths[name] = path or f"{self.folder}/{name}"
        return name

    def _known(self, path: str) -> str:
        """A table's name for the files of a level written earlier."""
        name = self._name(path)
        columns = ", ".join(f"`{c.split()[0]}` BIGINT" for c in RUN.split(", "))
        self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (head, print) SORTED BY (head, print) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return name

    def write(self, rows: DataFrame) -> str:
        """A table of rows that are in their buckets."""
        name = self._name()
        rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", self.paths[name]).option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def read(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        C.drop_stage(self.spark.table(name))
        self.spark.sql(f"DROP TABLE {name}")

    def all_levels(self) -> DataFrame:
        """Distinct (key, digest) of each level, counted in each."""
        return union([self.read(name) for name in self.levels.values()])

    def merged(self, *runs: str) -> str:
        """One table of several; buckets stay where they are."""
        return self.write(union([self.read(r) for r in runs]).groupBy(*KEY, *DIGEST).agg(F.sum("n").alias("n")))

    def met(self, run: str) -> str:
        """The run's keys that occur again, in it or in a level: each level is merge-scanned in the order of the keys."""
        own = self.read(run).groupBy(*KEY).agg(F.sum("n").alias("n"))
        found = [own.filter("n > 1").select(*KEY)]
        found += [own.select(*KEY).hint("merge").join(self.read(level).select(*KEY), KEY, "left_semi") for level in self.levels.values()]
        return self.write(union(found).distinct())

    def add(self, rows: DataFrame) -> str:
        """File one more batch of (key, digest, n); the table of its keys found again."""
        counted = rows.groupBy(*KEY, *DIGEST).agg(F.sum("n").alias("n"))
        run = self.write(counted.repartition(self.buckets, *KEY))
        with in_order(self.spark):
            met = self.met(run)
            levels, k, old = dict(self.levels), 0, []
            while k in levels:
                old += [run, levels[k]]
                run, k = self.merged(run, levels.pop(k)), k + 1
        levels[k] = run
        entries = [(level, self.paths[name], self.buckets) for level, name in levels.items()]
        tables.write_snapshot({"levels": self.spark.createDataFrame(entries, "level int, path string, buckets int").coalesce(1)}, f"{self.folder}/versions")
        self.levels = levels
        for name in old:
            self.drop(name)
        return met

    def close(self, keep: bool = True) -> None:
        """Forget the levels' names; without ``keep`` their files go too."""
        for name in self.levels.values():
            if keep:
                self.spark.sql(f"DROP TABLE {name}")
            else:
                self.drop(name)
        self.levels = {}


@contextmanager
def in_order(spark: SparkSession) -> Iterator[None]:
    """Scans of buckets that are one sorted file each count as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def windows(undecided: DataFrame) -> DataFrame:
    """(w1, w2, key, hash, at, open) of each string of the suffixes in ``todo``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())

        def emit(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["w1", "w2", "row", "at", "open"])

        rows: list[tuple] = []
        for batch in batches:
            for row, text, todo in zip(*[c.to_pylist() for c in batch.columns]):
                data = C.utf8(text)
                for s in todo:
                    for x in range(s["low"], s["high"] + 1):
                        d = xxhash.xxh3_128_digest(data[x : x + LENGTH])
                        rows.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), row, x, s["open"]))
                    if len(rows) > 100_000:
                        yield emit(rows)
                        rows = []
        if rows:
            yield emit(rows)

    return undecided.select("row", "_own", "todo").mapInArrow(run, "w1 long, w2 long, row long, at int, open boolean")


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by (start, end) spans."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def decided(entries: DataFrame, known: DataFrame, place: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repeated, undecided, partners) of entries with key, digest and ``place``.

    ``known`` (staged) counts distinct (key, digest). Entries whose key occurs once are dropped: none of their strings is repeated.
    """
    totals = known.groupBy(*KEY).agg(F.min("n").alias("least"), F.sum("n").alias("total")).filter("total > 1")
    known = C.stage(known.join(totals, KEY).select(*KEY, *DIGEST, "n", (F.col("least") == 1).alias("contested")), "known")
    found = C.stage(entries.join(known, [*KEY, *DIGEST]), "repeated")
    partner = found.filter("contested and n > 1").groupBy(*KEY, *DIGEST).agg(F.min(F.struct(*place)).alias("p")).select("p.*")
    return found.filter("n > 1"), found.filter("n = 1"), partner


def texts_of(docs: DataFrame, batches: int) -> DataFrame:
    """(row, key, hash, text, sure, todo) of the texts with suffixes found again. ``docs`` has _key, _hash, _own."""
    spark = docs.sparkSession
    rows = C.stage(with_suffixes(docs), "suffixes")
    times = F.when(F.col("till") > F.col("high"), 2).otherwise(1).cast("long").alias("n")
    family = Family(spark, f"{C.shared_dir(spark)}/family-{uuid.uuid4().hex}")
    met = [family.add(rows.filter(F.pmod(F.xxhash64("_key", "_hash"), F.lit(batches)) == b).select(*KEY, *DIGEST, times)) for b in range(batches)]
    with in_order(spark):
        again = union([family.read(m) for m in met]).distinct()
        known = family.write(family.all_levels().hint("merge").join(again, KEY, "left_semi").groupBy(*KEY, *DIGEST).agg(F.sum("n").alias("n")))
        place = ["_key", "_hash", "low", "high", "anchor"]
        sure, undecided, partner = decided(rows, family.read(known), place)
    for name in (*met, known):
        family.drop(name)
    family.close(keep=False)
    C.drop_stage(rows)
    own = lambda df, is_sure, is_open, last="high": df.select("_key", "_hash", F.lit(is_sure).alias("is_sure"), F.struct("low", F.col(last).alias("high"), "anchor", F.lit(is_open).alias("open")).alias("s"))
    tagged = own(sure, True, False, "till").unionByName(own(undecided, False, True)).unionByName(own(partner, False, False))
    by_text = tagged.groupBy(F.col("_key").alias("_k"), F.col("_hash").alias("_h")).agg(
        F.collect_list(F.when(F.col("is_sure"), F.struct("s.low", "s.high"))).alias("sure"), F.collect_list(F.when(~F.col("is_sure"), F.col("s"))).alias("todo")
    )
    joined = docs.join(by_text, docs["_key"].eqNullSafe(F.col("_k")) & (docs["_hash"] == F.col("_h")))
    return C.stage(joined.select("_key", "_hash", "_own", "sure", "todo").withColumn("row", F.monotonically_increasing_id()), "texts")


def parts(texts: DataFrame) -> DataFrame:
    """(row, low, high, anchor, head, print, d1, d2, n, open) of the parts of the suffixes in ``todo``; a partner's are known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        for batch in batches:
            rows = []
            for row, text, todo in zip(*[c.to_pylist() for c in batch.columns]):
                data = C.utf8(text)
                for t in todo:
                    rows += [(row, *p, 1 if t["open"] else 2, t["open"]) for p in parts_of(data, t["low"], t["high"], t["anchor"])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["row", *SUFFIX.names, "n", "open"])

    schema = "row long, low int, high int, anchor int, head long, print long, d1 long, d2 long, n long, open boolean"
    return texts.filter(F.size("todo") > 0).select("row", "_own", "todo").mapInArrow(run, schema)


def with_removed(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(key, hash, n_removed, n_spans, kept_sha256, runs) of each distinct text that loses bytes. ``docs`` has _key, _hash, _own."""
    texts = texts_of(docs, batches)
    cut = C.stage(parts(texts), "parts")
    known = C.stage(cut.groupBy(*KEY, *DIGEST).agg(F.sum("n").alias("n")), "counts")
    sure, undecided, partner = decided(cut.drop("n"), known, ["row", "low", "high"])
    undecided = undecided.filter("open")
    each = undecided.select("row", "low", "high", F.lit(True).alias("open")).unionByName(partner.withColumn("open", F.lit(False)))
    todo = each.groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("low", "high", "open")).alias("todo"))
    strings = C.stage(windows(texts.drop("todo").join(todo, F.col("row") == F.col("of"))), "strings")
    several = C.stage(strings.groupBy("w1", "w2").agg(F.count("*").alias("k")).filter("k > 1").select("w1", "w2"), "several")
    hits = strings.filter("open").join(several, ["w1", "w2"], "left_semi").select("row", F.col("at").alias("low"), F.col("at").alias("high"))
    hits = hits.unionByName(sure.filter("open").select("row", "low", "high")).groupBy(F.col("row").alias("of")).agg(F.collect_list(F.struct("low", "high")).alias("found"))
    joined = texts.drop("todo").join(hits, F.col("row") == F.col("of"), "left")

    def make():
        def work(texts, sure, found):
            out = []
            for t, own, more in zip(texts, sure, found):
                data = C.utf8(t)
                runs = covered([(s["low"], s["high"] + LENGTH) for s in [*(own or ()), *(more or ())]])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                out.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest(), [{"start": a, "end": b} for a, b in runs]))
            return [list(c) for c in zip(*out)]

        return work

    run = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), ("runs", T.ArrayType(run))]
    done = C.map_texts(joined, "_own", fields, make, carry=["_key", "_hash"], also=["sure", "found"])
    return done.select(*C.unpack(done, "_key", "_hash"), *[n for n, _ in fields]).filter("n_removed > 0")


def judge(docs: DataFrame, key: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, runs) for each row; runs are byte ranges of the original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_hash"), text.alias("_own"))
    found = with_removed(own, batches).select(F.col("_key").alias("_k"), F.col("_hash").alias("_h"), "n_removed", "n_spans", "kept_sha256", "runs")
    found = C.stage(found.dropDuplicates(["_k", "_h"]), "removed")
    whole = own.select("_key", "_hash", F.octet_length("_own").cast("long").alias("n_bytes"), F.sha2("_own", 256).alias("whole"))
    done = whole.join(found, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.lit(0).cast("long")
    return done.select(
        F.col("_key").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("runs", none).alias("runs"),
    )
