"""Session settings and tables staged in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that results depend on: dates are UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a local session, whose tasks all run on this machine, gets a temporary one; any other session fails.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        known = sc.getCheckpointDir()
    return known.rstrip("/")


_SCOPE: ContextVar[Scope | None] = ContextVar("scope", default=None)


class Scope:
    """Tables staged inside go when it ends, but those that are kept; an outer scope has those then.

    What is made inside and used after it must be staged and kept.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def __enter__(self) -> Scope:
        self._outer, self._token = _SCOPE.get(), _SCOPE.set(self)
        return self

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """The table, staged now, and not to go with the scope."""
        out = stage(df, name)
        path = self.made.pop()
        if self._outer is not None:
            self._outer.made.append(path)
        return out

    def __exit__(self, *_: object) -> None:
        _SCOPE.reset(self._token)
        for path in self.made:
            _delete(self.spark, path)


#: For tables with many digests, which take half the room so.
PACKED = {"compression": "zstd"}


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/table-{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    if _SCOPE.get() is not None:
        _SCOPE.get().made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stage(*tables: DataFrame) -> None:
    """Remove staged tables that no one will read again."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, name)
