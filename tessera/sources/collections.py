"""Keyed collections of rows in Parquet: get, upsert, delete, and caches of what is costly to compute.

A collection's rows lie in buckets by a hash of their key.  A version is a manifest, a small JSON file that names each bucket's folder; the
newest whole manifest counts.  Writing puts the buckets that change into new folders first and publishes a manifest last, by a rename
that fails if another writer was first.  So readers see a whole version always, a failed or concurrent write leaves the last one as it
was, and buckets without changes aren't rewritten.  A lookup of stated keys reads their buckets only.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.tables import delete, written

BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has published the version that this one meant to."""


class Collection:
    """The collection at ``path``, made with ``key`` and ``schema`` where there is none."""

    def __init__(self, spark: SparkSession, path: str, key: list[str] | None = None, schema: T.StructType | str | None = None, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        if not self._versions():
            if key is None or schema is None:
                raise ValueError(f"no collection at {path}; key and schema are needed to make one")
            fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            self._publish(0, {"key": key, "schema": fields.json(), "buckets": buckets, "folders": {}})
        made = self.manifest()
        self.key, self.buckets, self.schema = made["key"], made["buckets"], T.StructType.fromJson(json.loads(made["schema"]))

    def _fs(self):
        return self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _versions(self) -> list[int]:
        if not self._fs().exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs().listStatus(self._at("manifests"))]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n)))

    @property
    def version(self) -> int:
        return self._versions()[-1]

    def manifest(self, version: int | None = None) -> dict:
        stream = self._fs().open(self._at(f"manifests/v{self.version if version is None else version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        fs, draft, final = self._fs(), self._at(f"manifests/draft-{uuid.uuid4().hex}"), self._at(f"manifests/v{version}.json")
        out = fs.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def _matched(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        named = keys.select(*[F.col(k).alias(f"_key_{k}") for k in self.key])
        on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in self.key]
        return rows.join(named, on, how)

    def _touched(self, keys: DataFrame) -> list[str]:
        return [str(r[0]) for r in keys.select(self._bucket()).distinct().collect()]

    def get(self, keys: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """All rows of a version (the newest), or those of the stated keys; then only these keys' buckets are read."""
        folders = self.manifest(version)["folders"]
        if keys is None:
            return self._read(sorted(folders.values()))
        wanted = keys.select(self.key).distinct()
        return self._matched(self._read(sorted(folders[b] for b in self._touched(wanted) if b in folders)), wanted, "left_semi")

    def missing(self, keys: DataFrame) -> DataFrame:
        """The stated keys that aren't there, once each."""
        wanted = keys.select(self.key).distinct()
        return self._matched(wanted, self.get(wanted), "left_anti")

    def _replace(self, gone: DataFrame, fresh: DataFrame | None) -> list[int]:
        """Rewrites the buckets of ``gone`` (keys) without these keys and with the rows of ``fresh``; gives the buckets."""
        version = self.version
        manifest = self.manifest(version)
        touched = self._touched(gone)
        if not touched:
            return []
        old = self._read(sorted(manifest["folders"][b] for b in touched if b in manifest["folders"]))
        rows = self._matched(old, gone, "left_anti")
        rows = rows if fresh is None else rows.unionByName(fresh.select(self.schema.names))
        folder = f"data/{uuid.uuid4().hex}"
        parts = max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        try:
            rows.withColumn("_bucket", self._bucket()).repartition(parts, "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            held = {s.getPath().getName().removeprefix("_bucket=") for s in self._fs().listStatus(self._at(folder))}
            for b in touched:
                manifest["folders"].pop(b, None)
                if b in held:
                    manifest["folders"][b] = f"{folder}/_bucket={b}"
            self._publish(version + 1, manifest)
        except BaseException:
            delete(self.spark, f"{self.path}/{folder}")
            raise
        return sorted(map(int, touched))

    def upsert(self, rows: DataFrame) -> list[int]:
        """Rows replace those of their key or are added (of equal keys in ``rows`` the greatest row counts); rows that are there as they are
        change nothing.  Gives the buckets that were rewritten."""
        values = [c for c in self.schema.names if c not in self.key]
        given = rows.select([F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        once = written(given.groupBy(*self.key).agg(F.max(F.struct(*values)).alias("_row")).select(*self.key, "_row.*").select(self.schema.names))
        held = self.get(once).select(*[F.col(c).alias(f"_key_{c}") for c in self.schema.names])
        fresh = written(once.join(held, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in self.schema.names], "left_anti"))
        return self._replace(fresh.select(self.key), fresh)

    def remove(self, condition: Column) -> list[int]:
        """Rows that fulfil the condition leave.  Gives the buckets that were rewritten."""
        return self._replace(written(self.get().filter(condition).select(self.key)), None)

    def vacuum(self, keep: int = 1) -> None:
        """Removes all versions but the newest ``keep``, and folders that none of those names."""
        versions = self._versions()[-keep:]
        named = {f.split("/")[1] for v in versions for f in self.manifest(v)["folders"].values()}
        for v in self._versions():
            if v not in versions:
                self._fs().delete(self._at(f"manifests/v{v}.json"), False)
        if self._fs().exists(self._at("data")):
            for s in self._fs().listStatus(self._at("data")):
                if s.getPath().getName() not in named:
                    self._fs().delete(s.getPath(), True)


def cached(collection: Collection, items: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The collection's rows for ``items`` (with its key columns); only what isn't there is computed, from its items, and stored."""
    kept = written(items)
    missing = written(collection.missing(kept))
    if not missing.isEmpty():
        collection.upsert(compute(collection._matched(kept, missing, "left_semi")))
    return collection.get(kept)


def query_key(query: Column, config: str, collection: str, n: int) -> Column:
    """The key of a cached search: MD5 of the query, the embedding's configuration, the collection's name and how many are wanted."""
    return F.md5(F.concat_ws("\x1f", query, F.lit(config), F.lit(collection), F.lit(str(n))))
