"""A table set in buckets by key, with a manifest for each version.

A row's bucket comes from its key's hash, and the number of buckets is fixed when the store is made, by its maker. A commit
reads, merges and writes just the buckets that its rows fall in, each into a folder of its own; the new manifest names them
and, for all others, the folders of the version before. The manifest appears by one rename that overwrites nothing, so
readers see whole versions and a second writer of the same version fails. Folders that no kept version names are removed.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.sources.tables import hadoop_path, rename_once

#: Versions that stay readable.
KEPT = 3


class Table(NamedTuple):
    """A table's schema, the columns of its key and its number of buckets."""

    schema: str
    key: tuple[str, ...]
    buckets: int


class Store:
    """The tables under ``root``; all of them are there, empty, before the first commit. The first version's numbers of buckets stay."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table]):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = tables
        known = self.manifest()["buckets"]
        self.tables = {name: t._replace(buckets=known.get(name, t.buckets)) for name, t in tables.items()}

    def _bucket(self, name: str) -> Column:
        return F.pmod(F.xxhash64(*self.tables[name].key), F.lit(self.tables[name].buckets)).cast("int")

    def versions(self) -> list[int]:
        path, fs = hadoop_path(self.spark, f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n[2:-5]) for n in names if n.startswith("v-"))

    def manifest(self, version: int | None = None) -> dict:
        """{"batch": ..., "tables": {name: {bucket: folder}}} of a version, the last one if none is given."""
        known = self.versions()
        if not known:
            return {"batch": None, "buckets": {name: t.buckets for name, t in self.tables.items()}, "tables": {name: {} for name in self.tables}}
        number = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/manifests/v-{number:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table of one version, or some of its buckets."""
        folders = self.manifest(version)["tables"].get(name, {})
        wanted = [f"{self.root}/{f}" for b, f in sorted(folders.items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        if not wanted:
            return self.spark.createDataFrame([], self.tables[name].schema)
        return self.spark.read.schema(self.tables[name].schema).parquet(*wanted)

    def read_all(self) -> dict[str, DataFrame]:
        """All tables, of the same version."""
        version = (self.versions() or [None])[-1]
        return {name: self.read(name, version) for name in self.tables}

    def commit(self, put: dict[str, DataFrame], drop: dict[str, DataFrame] | None = None, batch: int | None = None) -> dict[str, list[int]]:
        """Put rows in place of those with the same key, drop the rows of the keys given, and publish; the buckets written by table.

        A batch's number is kept with the version: one that is there already is not done again. Rows given twice by key must be equal in all columns.
        """
        before, number = self.manifest(), (self.versions() or [0])[-1]
        if batch is not None and before["batch"] is not None and before["batch"] >= batch:
            return {}
        after, wrote = {name: dict(folders) for name, folders in before["tables"].items()}, {}
        for name, (schema, key, _) in self.tables.items():
            rows, gone = (put or {}).get(name), (drop or {}).get(name)
            if rows is None and gone is None:
                continue
            fresh = (rows if rows is not None else self.spark.createDataFrame([], schema)).dropDuplicates(list(key))
            out = [c for c in self.spark.createDataFrame([], schema).columns]
            folder = f"{name}/{uuid.uuid4().hex}"
            staged = f"{self.root}/{folder}-new"
            fresh.select(*out).withColumn("_bucket", self._bucket(name)).write.partitionBy("_bucket").parquet(staged)
            fresh = self.spark.read.parquet(staged) if self._buckets_in(staged) else self.spark.createDataFrame([], schema).withColumn("_bucket", F.lit(0))
            touched = set(self._buckets_in(staged))
            leaving = gone.select(*[F.col(c).alias(f"_{c}") for c in key]).unionByName(fresh.select(*[F.col(c).alias(f"_{c}") for c in key])) if gone is not None else fresh.select(*[F.col(c).alias(f"_{c}") for c in key])
            if gone is not None:
                touched |= {r[0] for r in gone.select(self._bucket(name).alias("b")).distinct().collect()}
            if touched:
                same = F.lit(True)
                for c in key:
                    same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
                kept = self.read(name, number or None, sorted(touched)).join(leaving, same, "left_anti").select(*out).withColumn("_bucket", self._bucket(name))
                kept.unionByName(fresh.select(*out, "_bucket")).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/{folder}")
                there = self._buckets_in(f"{self.root}/{folder}")
                after.setdefault(name, {}).update({str(b): f"{folder}/_bucket={b}" for b in there})
                for b in touched - set(there):
                    after[name].pop(str(b), None)
                wrote[name] = sorted(touched)
            path, fs = hadoop_path(self.spark, staged)
            fs.delete(path, True)
        self._publish({"batch": batch if batch is not None else before["batch"], "buckets": {name: t.buckets for name, t in self.tables.items()}, "tables": after}, number + 1)
        self._prune()
        return wrote

    def _buckets_in(self, folder: str) -> list[int]:
        path, fs = hadoop_path(self.spark, folder)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("_bucket="))

    def _publish(self, manifest: dict, number: int) -> None:
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        path, fs = hadoop_path(self.spark, aside)
        out = fs.create(path)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        folder, _ = hadoop_path(self.spark, f"{self.root}/manifests")
        fs.mkdirs(folder)
        rename_once(self.spark, aside, f"{self.root}/manifests/v-{number:012d}.json")

    def _prune(self) -> None:
        """Remove the manifests beyond the last ``KEPT``, and the folders that no kept one names."""
        known = self.versions()
        kept = [self.manifest(v) for v in known[-KEPT:]]
        named = {f for m in kept for folders in m["tables"].values() for f in folders.values()}
        for v in known[:-KEPT]:
            old = self.manifest(v)
            path, fs = hadoop_path(self.spark, f"{self.root}/manifests/v-{v:012d}.json")
            fs.delete(path, False)
            for f in {f for folders in old["tables"].values() for f in folders.values()} - named:
                path, fs = hadoop_path(self.spark, f"{self.root}/{f}")
                fs.delete(path, True)
                if not self._buckets_in(f"{self.root}/{f.rsplit('/', 1)[0]}"):
                    fs.delete(path.getParent(), True)
