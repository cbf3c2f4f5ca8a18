"""Capture as a stream: events are normalised, gated and matched; each batch is recorded as one unit, or not at all.

``files`` is what is on disk now: (file_path, mtime, file_size, content_hash, identity). The store is in buckets
(``sources.store``); a batch writes the buckets that its changes fall in and publishes the next version, so readers never
see half a batch, and a batch that is tried again after it was published does nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from valuegrain.operators.extract import extract
from valuegrain.operators.record import Changes, canonical_agent, record_batch, record_changes, within_limit
from valuegrain.sources.staging import Scope, stage
from valuegrain.sources.store import Store, Table
from valuegrain.streaming.events import MAX_BYTES, eligible, normalise, snapshot_matches

SCHEMA = "event_id long, ts timestamp, agent string, payload string"
STORE = {
    "nodes": "id string, node_type string, value_kind string, number_val double, date_val timestamp, duration_secs long, source_id long, line_number int, is_stale boolean, stale_reason string, created_at timestamp, updated_at timestamp",
    "edges": "edge_id long, parent_id string, child_id string, operation string, expression string",
    "sources": "source_id long, file_path string, mtime timestamp, file_size long, content_hash string, last_checked_at timestamp, identity string",
    "captures": "node_id string, agent string",
}
#: Keys of the store's tables.
KEYS = {"nodes": ("id",), "edges": ("parent_id", "child_id"), "sources": ("file_path",), "captures": ("node_id", "agent")}
#: How long after its first arrival an event that arrives again is known.
REPEATS = "1 day"


def read_events(spark: SparkSession, folder: str, kind: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(SCHEMA)
    return (reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)).load(folder)


def _normalised(events: DataFrame) -> DataFrame:
    """Events under their agents' canonical names; those of unknown agents have none but a name given."""
    named = events.withColumn("named", F.col("agent")).withColumn("agent", canonical_agent(F.col("agent")))
    return normalise(named)


def _known() -> Column:
    return F.col("named").isNull() | F.col("agent").isNotNull()


def rejects(events: DataFrame) -> DataFrame:
    """(event_id, reason) of events that can't be read: too large, of an unknown agent, or malformed."""
    own = _normalised(events)
    reason = F.when(F.octet_length("payload") > MAX_BYTES, "OVERSIZED").when(~_known(), "UNKNOWN_AGENT").when(F.col("phase").isNull(), "MALFORMED")
    return own.select("event_id", reason.alias("reason")).filter("reason is not null")


def captured(events: DataFrame, files: DataFrame) -> DataFrame:
    """Eligible events whose content is the file's as it is now; works on a batch and on a stream (against a static table)."""
    own = _normalised(events).filter(_known()).drop("named")
    return snapshot_matches(own.filter(eligible()), files).filter("matches")


def values_of(events: DataFrame, number_format: str = "auto") -> tuple[DataFrame, DataFrame]:
    """(values, agents) of captured events: extracted values by file, and (file_path, agent).

    A file's content is that of its last event. A file of which some value lies on a line that wasn't returned has no values.
    """
    last = events.groupBy("path").agg(F.max_by(F.struct("content", "n_lines"), F.struct("ts", "event_id")).alias("_last"), F.collect_set("agent").alias("agents"))
    texts = stage(last.select(F.col("path").alias("file_path"), "_last.content", "_last.n_lines", "agents").withColumn("number_format", F.lit(number_format)), "texts")
    found = stage(extract(texts.select("file_path", "content", "number_format")), "found")
    values = stage(within_limit(found).filter("kept").drop("kept"), "values")
    beyond = values.join(texts.select(F.col("file_path").alias("_p"), "n_lines"), (F.col("file_path") == F.col("_p")) & (F.col("line") > F.col("n_lines"))).select(F.col("file_path").alias("_b")).distinct()
    whole = values.join(beyond, F.col("file_path") == F.col("_b"), "left_anti")
    agents = texts.join(beyond, F.col("file_path") == F.col("_b"), "left_anti").select("file_path", F.explode("agents").alias("agent"))
    return whole, agents


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    return {k: spark.createDataFrame([], v) for k, v in STORE.items()}


def store_at(spark: SparkSession, root: str, buckets: int = 16) -> Store:
    """The store under a folder; the number of buckets is that of its first version for good."""
    return Store(spark, f"{root}/store", {k: Table(v, KEYS[k], buckets) for k, v in STORE.items()})


def _batch(events: DataFrame, files: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, sources, agents) to record. A new path's id is a digest of the path."""
    values, agents = values_of(stage(captured(events, files), "captured"))
    paths = agents.select(F.col("file_path").alias("_p")).distinct()
    own = files.join(paths, F.col("file_path") == F.col("_p"), "left_semi")
    sources = own.select(F.pmod(F.xxhash64("file_path"), F.lit(1 << 62)).alias("source_id"), "file_path", "mtime", "file_size", "content_hash", now.alias("last_checked_at"), "identity")
    return values, sources, agents


def record_events(events: DataFrame, files: DataFrame, store: dict[str, DataFrame], now: Column) -> dict[str, DataFrame]:
    """The whole store after the events, recorded as one batch."""
    values, sources, agents = _batch(events, files, now)
    nodes, kept, captures = record_batch(store["nodes"], store["edges"], store["sources"], store["captures"], values, sources, now, agents)
    return {"nodes": nodes, "edges": store["edges"], "sources": kept, "captures": captures}


def event_changes(events: DataFrame, files: DataFrame, store: dict[str, DataFrame], now: Column) -> Changes:
    """What the events change in the store, recorded as one batch."""
    values, sources, agents = _batch(events, files, now)
    return record_changes(store["nodes"], store["edges"], store["sources"], store["captures"], values, sources, now, agents)


def once(events: DataFrame, repeats: str = REPEATS) -> DataFrame:
    """A stream's events without those that came before, the same in all columns, within the time given.

    The state is kept by arrival, not by the events' own times, so no event is too late to be taken.
    """
    arrived = events.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", repeats)
    return arrived.dropDuplicatesWithinWatermark(events.columns).drop("_arrived")


def start(events: DataFrame, files: DataFrame, root: str, checkpoint: str, now: Column | None = None, repeats: str = REPEATS, buckets: int = 16) -> StreamingQuery:
    """Run what is there and stop. Each batch commits its changes to the store under ``root``/store, and writes what it refused under ``root``/rejects.

    Without ``now`` rows are stamped with the batch's last event time.
    """

    def record(batch: DataFrame, number: int) -> None:
        store = store_at(batch.sparkSession, root, buckets)
        with Scope(batch.sparkSession):  # the batch leaves what it commits
            own = stage(batch, "batch")
            rejects(own).write.mode("overwrite").parquet(f"{root}/rejects/batch={number}")
            last, n = own.agg(F.max("ts"), F.count("*")).first()
            if n == 0:  # nothing but repeats, or a batch that only moves the watermark
                return
            stamp = now if now is not None else F.current_timestamp() if last is None else F.lit(last)
            made = event_changes(own, files, store.read_all(), stamp)
            store.commit({"nodes": made.nodes, "sources": made.sources, "captures": made.captures}, {"sources": made.lost}, number)

    return once(events, repeats).writeStream.foreachBatch(record).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recorded(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The store's last version, and the rejects of all batches."""
    return {**store_at(spark, root).read_all(), "rejects": spark.read.schema("event_id long, reason string").parquet(f"{root}/rejects").select("event_id", "reason")}
