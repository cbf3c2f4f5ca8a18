"""Sources: texts with fingerprints, file metadata, snapshots of the table set."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Inline content; its earlier values are never invalidated and it is never checked for changes.
from valuegrain.functions.text import VIRTUAL  # noqa: F401
from valuegrain.sources.staging import stage

TABLES = ("sources", "nodes", "edges", "captures", "settings")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def texts(df: DataFrame, path: str | Column, content: str | Column, number_format: Column | None = None) -> DataFrame:
    """(file_path, content, content_hash, file_size, number_format) of any table with a path and a text."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    out = df.select(as_col(path).alias("file_path"), as_col(content).alias("content"), (number_format if number_format is not None else F.lit(None)).cast("string").alias("number_format"))
    return out.withColumns({"content_hash": fingerprint(F.col("content")), "file_size": F.octet_length("content").cast("long")})


def files(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(file_path, mtime, file_size, content) of files; unread columns are never loaded."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file_path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("file_size"), "content")


def text_lines(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(file_path, line, text) of text files of any size: files are read in splits, and no row holds more than a line.

    A line's number is its place in its split and the lines of the file's splits before, which are counted in a pass of their own.
    """
    read = spark.read.option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
    own = read.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("text"))
    splits = own.groupBy("file_path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file_path").orderBy("_block")) - F.col("_n")  # a row for each split
    starts = stage(splits.select(F.col("file_path").alias("_p"), F.col("_block").alias("_b"), (before - F.col("_first") + 1).alias("_shift")), "splits")
    met = own.join(starts, (F.col("file_path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return met.select("file_path", (F.col("_at") + F.col("_shift")).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def utf8_gate(df: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Texts decoded from valid UTF-8, and the rows that are no text."""
    text = F.try_validate_utf8(F.col(content).cast("string"))
    valid = F.is_valid_utf8(F.col(content).cast("string"))
    return df.filter(valid).withColumn(content, text), df.filter(~F.coalesce(valid, F.lit(False))).drop(content).withColumn("status", F.lit("UNSUPPORTED"))


def number_format(explicit: Column, setting: Column) -> Column:
    """The explicit format, else the project's setting, else auto; unknown names count as unset."""
    known = lambda c: F.when(F.lower(c).isin("us", "eu", "auto"), F.lower(c))
    return F.coalesce(known(explicit), known(setting), F.lit("auto"))


def hadoop_path(spark: SparkSession, name: str) -> tuple:
    """A path and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the complete versions, in order."""
    path, fs = hadoop_path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v-"))


def write_snapshot(tables: dict[str, DataFrame], root: str) -> str:
    """Write a table set aside and then rename it to the next version, in one step.

    Readers see all of a version or none of it. If another writer took the number first, the rename fails and so does the call.
    """
    spark = next(iter(tables.values())).sparkSession
    aside = f"{root}/_aside-{uuid.uuid4().hex}"
    for k, df in tables.items():
        df.write.parquet(f"{aside}/{k}")
    name = f"v-{(versions(spark, root) or [0])[-1] + 1:012d}"
    rename_once(spark, aside, f"{root}/{name}")
    return name


def rename_once(spark: SparkSession, source: str, target: str) -> None:
    """Rename, and fail if the target is there."""
    sc = spark.sparkContext
    (old, _), (new, _) = hadoop_path(spark, source), hadoop_path(spark, target)
    context = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), sc._jsc.hadoopConfiguration())
    no_overwriting = sc._gateway.new_array(getattr(sc._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context.rename(old, new, no_overwriting)


def read_snapshot(spark: SparkSession, root: str, names: tuple[str, ...] = TABLES) -> dict[str, DataFrame]:
    """The current table set, all of one version; empty if there is none."""
    known = versions(spark, root)
    reads = {}
    for k in names if known else ():
        path, fs = hadoop_path(spark, f"{root}/v-{known[-1]:012d}/{k}")
        if fs.exists(path):
            reads[k] = spark.read.parquet(str(path))
    return reads
