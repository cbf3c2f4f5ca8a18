"""Change detection between stored sources and a snapshot of what is there now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.operators.graph import DELETED, MODIFIED, invalidate_sources
from valuegrain.sources.staging import stage
from valuegrain.sources.tables import VIRTUAL

#: Fixed value: a check older than this reads the content again whatever the metadata say.
REHASH_SECONDS = 3600


def metadata_differs(old: str = "o", now: str = "c") -> Column:
    """Time or size differ, or the file identity does where both are known."""
    known = F.col(f"{old}.identity").isNotNull() & F.col(f"{now}.identity").isNotNull()
    return (F.col(f"{old}.mtime") != F.col(f"{now}.mtime")) | (F.col(f"{old}.file_size") != F.col(f"{now}.file_size")) | (known & (F.col(f"{old}.identity") != F.col(f"{now}.identity")))


def suspects(sources: DataFrame, current: DataFrame, now: Column) -> DataFrame:
    """First tier: stored sources beside the current metadata, and whether the content must be read."""
    joined = sources.filter(F.col("file_path") != VIRTUAL).alias("o").join(current.alias("c"), F.col("o.file_path") == F.col("c.file_path"), "left")
    forced = F.unix_micros(now) - F.unix_micros(F.col("o.last_checked_at")) > REHASH_SECONDS * 1_000_000
    return joined.select("o.source_id", "o.file_path", F.col("o.content_hash").alias("old_hash"), F.col("c.file_path").isNotNull().alias("present"), "c.read_error", F.coalesce(metadata_differs() | forced, F.lit(False)).alias("must_read"))


def hash_suspects(first: DataFrame, contents: DataFrame) -> DataFrame:
    """(file_path, content_hash) of the suspects that can be read; no other content of (file_path, content) is hashed or shuffled.

    The suspects are the small side, so the contents are met where they are read; only where suspects
    are too many to be sent to every task does Spark join by path.
    """
    wanted = first.filter("must_read and present and read_error is null").select(F.col("file_path").alias("_w")).distinct()
    return contents.join(wanted, F.col("file_path") == F.col("_w"), "left_semi").select("file_path", F.sha2("content", 256).alias("content_hash"))


def detect(sources: DataFrame, current: DataFrame, contents: DataFrame, now: Column) -> DataFrame:
    """Both tiers: (source_id, file_path, status, new_hash) of stored sources against current metadata and, for suspects, contents."""
    first = stage(suspects(sources, current, now), "suspects")
    return classify(first, hash_suspects(first, contents))


def classify(first: DataFrame, hashes: DataFrame) -> DataFrame:
    """(source_id, file_path, status); ``hashes`` (file_path, content_hash) is needed for the suspects only."""
    joined = first.join(hashes.select(F.col("file_path").alias("_p"), "content_hash"), (F.col("file_path") == F.col("_p")) & F.col("must_read"), "left")
    status = (
        F.when(~F.col("present"), "FILE_NOT_FOUND").when(F.col("read_error").isNotNull(), "CHECK_FAILED").when(~F.col("must_read"), "UNCHANGED")
        .when(F.col("content_hash").isNull(), "CHECK_FAILED").when(F.col("content_hash") == F.col("old_hash"), "VERIFIED_UNCHANGED").otherwise("CHANGED")
    )
    return joined.select("source_id", "file_path", status.alias("status"), F.col("content_hash").alias("new_hash"))


def sync(nodes: DataFrame, edges: DataFrame, sources: DataFrame, verdicts: DataFrame, current: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, sources) after a check: changed and deleted sources stale all their roots and what derives from them.

    Verified and changed sources get the current metadata, failed ones only the time of the check; deleted rows stay.
    """
    reason = F.when(F.col("status") == "CHANGED", MODIFIED).when(F.col("status") == "FILE_NOT_FOUND", DELETED)
    changed = verdicts.select("source_id", reason.alias("reason")).filter("reason is not null")
    v = verdicts.select(F.col("source_id").alias("_s"), "status", "new_hash")
    c = current.select(F.col("file_path").alias("_p"), F.col("mtime").alias("_m"), F.col("file_size").alias("_z"))
    joined = sources.join(v, F.col("source_id") == F.col("_s"), "left").join(c, F.col("file_path") == F.col("_p"), "left")
    refreshed = F.coalesce(F.col("status").isin("CHANGED", "VERIFIED_UNCHANGED"), F.lit(False))
    touched = refreshed | F.coalesce(F.col("status") == "CHECK_FAILED", F.lit(False))
    values = {"mtime": F.when(refreshed, F.col("_m")), "file_size": F.when(refreshed, F.col("_z")), "content_hash": F.when(refreshed, F.col("new_hash")), "last_checked_at": F.when(touched, now)}
    own = joined.select(*[F.coalesce(values[k], F.col(k)).alias(k) if k in values else F.col(k) for k in sources.columns])
    return invalidate_sources(nodes, edges, changed), own
