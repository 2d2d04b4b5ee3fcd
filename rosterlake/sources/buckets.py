"""A keyed table in hash buckets with manifests: a change rewrites only the buckets that it touches.

Rows lie in `_bucket=<k>` folders under folders of their own for each write;
a manifest names the folder that holds each bucket.  Data files never change,
and a manifest appears by one rename that fails if its version exists, so
readers see whole versions, a job that dies leaves files that no manifest
names, and of two writers from one version the second fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlake.sources.tables import shuffled, upsert

_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    columns: str  # schema as JSON
    folders: dict[int, str] = field(default_factory=dict)  # bucket -> folder; buckets without rows are missing

    @property
    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.columns))


class BucketStore:
    """The store at a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        home = jvm.org.apache.hadoop.fs.Path(self.path)
        return home.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def versions(self) -> list[int]:
        fs, home = self._fs(), self._at("manifests")
        if not fs.exists(home):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(home)]
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> Manifest | None:
        """The newest manifest, or that of a version; None for an empty store."""
        have = self.versions()
        if not have:
            return None
        version = have[-1] if version is None else version
        raw = json.loads(self.spark.read.text(f"{self.path}/manifests/{version:010d}", wholetext=True).first()[0])
        return Manifest(version, raw["keys"], raw["buckets"], raw["columns"], {int(k): v for k, v in raw["folders"].items()})

    def _commit(self, m: Manifest) -> None:
        jvm, fs = self.spark._jvm, self._fs()
        temp, final = self._at("manifests", f"_{uuid.uuid4().hex}"), self._at("manifests", f"{m.version:010d}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps({"keys": m.keys, "buckets": m.buckets, "columns": m.columns, "folders": m.folders}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(temp, final, options)
        except Exception as e:
            fs.delete(temp, False)
            if fs.exists(final):
                raise Conflict(f"version {m.version} of {self.path} exists") from e
            raise

    def bucket(self, keys: list[str], buckets: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _written(self, rows: DataFrame, keys: list[str], buckets: int) -> dict[int, str]:
        """Write rows into a new folder; the buckets that have rows now, with their folders."""
        name = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn(_BUCKET, self.bucket(keys, buckets))
        placed.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{name}")
        made = [s.getPath().getName() for s in self._fs().listStatus(self._at(name))]
        return {int(n.split("=")[1]): f"{name}/{n}" for n in made if n.startswith(f"{_BUCKET}=")}

    def create(self, rows: DataFrame, keys: list[str], buckets: int) -> Manifest:
        """The first version; rows of one key share a bucket, null keys too."""
        if self.versions():
            raise Conflict(f"{self.path} holds a table")
        m = Manifest(0, keys, buckets, rows.schema.json(), self._written(rows, keys, buckets))
        self._commit(m)
        return m

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets; joins shuffle them, see `tables.shuffled`."""
        m = self.manifest(version)
        if m is None:
            raise FileNotFoundError(self.path)
        return shuffled(self._rows(m, m.folders if buckets is None else {b: m.folders[b] for b in buckets if b in m.folders}))

    def _rows(self, m: Manifest, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], m.schema)
        return self.spark.read.schema(m.schema).parquet(*(f"{self.path}/{d}" for d in folders.values()))

    def rewrite(self, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> Manifest:
        """A new version in which the buckets that hold the keys of `touched` are `change`d; all others stay the files they are.

        change: the present rows of those buckets -> their rows from now on
        (same columns; none may move to another bucket).  At most one number a
        bucket reaches the driver.
        """
        m = self.manifest()
        if m is None:
            raise FileNotFoundError(self.path)
        hit = sorted(r[0] for r in touched.select(self.bucket(m.keys, m.buckets)).distinct().collect())
        if not hit:
            return m
        present = {b: m.folders[b] for b in hit if b in m.folders}
        rows = change(self._rows(m, present)).select(*m.schema.names)
        made = self._written(rows, m.keys, m.buckets)
        strangers = made.keys() - set(hit)
        if strangers:
            raise ValueError(f"rows of untouched buckets: {sorted(strangers)[:5]}")
        kept = {b: d for b, d in m.folders.items() if b not in set(hit)}
        after = Manifest(m.version + 1, m.keys, m.buckets, m.columns, kept | made)
        self._commit(after)
        return after

    def upsert(self, new: DataFrame) -> tuple[Manifest, dict[str, int]]:
        """Insert or refresh by key; also how many rows of the touched buckets were inserted, refreshed, unchanged, kept."""
        m = self.manifest()
        seen = Observation()
        counted = [F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ("inserted", "refreshed", "unchanged", "kept")]
        after = self.rewrite(new, lambda old: upsert(old, new.select(*old.columns), m.keys).observe(seen, *counted).drop("action"))
        return after, dict(seen.get) if after.version > m.version else dict.fromkeys(("inserted", "refreshed", "unchanged", "kept"), 0)

    def replace(self, gone: DataFrame, new: DataFrame) -> Manifest:
        """All rows with the keys of `gone` or of `new` make way for the rows of `new`."""
        keys = self.manifest().keys
        touched = gone.select(*keys).unionByName(new.select(*keys)).distinct()
        same = lambda old: [old[k].eqNullSafe(touched[k]) for k in keys]
        return self.rewrite(touched, lambda old: old.join(touched, same(old), "left_anti").unionByName(new))

    def vacuum(self, keep: int = 1) -> int:
        """Delete all but the newest `keep` versions, and data that no kept one names; for times without writers.  Returns folders deleted."""
        have = self.versions()
        fs, gone = self._fs(), 0
        kept = [self.manifest(v) for v in have[-keep:]]
        named = {d for m in kept for d in m.folders.values()}
        for v in have[:-keep]:
            fs.delete(self._at("manifests", f"{v:010d}"), False)
        for write in [s.getPath().getName() for s in fs.listStatus(self._at("data"))]:
            for part in [s.getPath().getName() for s in fs.listStatus(self._at("data", write))]:
                if part.startswith(f"{_BUCKET}=") and f"data/{write}/{part}" not in named:
                    fs.delete(self._at("data", write, part), True)
                    gone += 1
        return gone
