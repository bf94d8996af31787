"""Versioned snapshots on any Hadoop file system.

A collection is a set of hash buckets of its key, each a Parquet directory sorted by the ordered fields. A write reads and rewrites
the buckets that it touches and nothing else. What counts is the newest manifest: it is put in place by one rename that fails if the
name is taken, so writers of several collections commit all or nothing, and readers that hold a manifest see no later write.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WriteConflict
from ..schema import ORDERED, CollectionSchema

BUCKETS = 16


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a local folder only where the master is local and names none."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestrata-"))
        shared = sc.getCheckpointDir()
    return f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}"


class Store:
    """Manifests and data below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self._path(f"{self.root}/manifests"))

    # -- manifests

    def latest(self) -> int:
        found = [int(s.getPath().getName()[:-5]) for s in self.files.listStatus(self._path(f"{self.root}/manifests")) if s.getPath().getName().endswith(".json") and s.getPath().getName()[:-5].isdigit()]
        return max(found, default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        if not version:
            return {"version": 0, "collections": {}, "counters": {}, "read_only": False}
        stream = self.files.open(self._path(self._name(version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def publish(self, manifest: dict, base: int) -> int:
        """Make ``manifest`` version base + 1, or raise WriteConflict if another writer was first."""
        version = base + 1
        body = json.dumps(manifest | {"version": version})
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self.files.create(draft, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        target = self._path(self._name(version))
        taken = self.files.exists(target) or not self.files.rename(draft, target)
        if taken:
            self.files.delete(draft, False)
            raise WriteConflict(f"version {version} exists")
        return version

    # -- data

    def bucket(self, schema: CollectionSchema, count: int) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{schema.key}`")), F.lit(count)).cast("int")

    def write(self, df: DataFrame, schema: CollectionSchema, count: int) -> dict[str, str]:
        """Bucket -> directory of the rows written."""
        path = f"{self.root}/data/{schema.name.lower()}-{uuid.uuid4().hex}"
        order = [f.name for f in schema.fields if f.index == ORDERED] or [schema.key]
        # Several tasks share a bucket where the session asks for more partitions than there are buckets.
        spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // count)
        deal = F.pmod(F.xxhash64(F.col(f"`{schema.key}`"), F.lit(1)), F.lit(spread))
        placed = df.withColumn("__bucket", self.bucket(schema, count)).repartition("__bucket", deal)
        placed.sortWithinPartitions("__bucket", *[F.col(f"`{c}`") for c in order]).write.partitionBy("__bucket").parquet(path)
        if not self.files.exists(self._path(path)):
            return {}
        return {s.getPath().getName().split("=")[1]: f"{path}/{s.getPath().getName()}" for s in self.files.listStatus(self._path(path)) if s.isDirectory()}

    def read(self, schema: CollectionSchema, entry: dict, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of all buckets, or of some."""
        wanted = entry["buckets"] if buckets is None else {str(b): entry["buckets"][str(b)] for b in buckets if str(b) in entry["buckets"]}
        struct = T.StructType([T.StructField(f.name, f.dataType) for f in schema.struct()])
        if not wanted:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).option("recursiveFileLookup", "true").parquet(*wanted.values())

    def buckets_of(self, keys: DataFrame, schema: CollectionSchema, count: int) -> list[int]:
        """The buckets that some keys fall into: at most ``count`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket(schema, count).alias("b")).distinct().collect())

    def remove(self, path: str) -> None:
        self.files.delete(self._path(path), True)

    def vacuum(self, keep: int = 10) -> int:
        """Delete data directories that none of the last ``keep`` manifests names; returns how many. Readers of older versions lose theirs."""
        last = self.latest()
        used = set()
        for v in range(max(1, last - keep + 1), last + 1):
            for entry in self.manifest(v)["collections"].values():
                used |= {p.rsplit("/", 1)[0].rsplit("/", 1)[1] for p in entry["buckets"].values()}
        gone = 0
        data = self._path(f"{self.root}/data")
        for s in self.files.listStatus(data) if self.files.exists(data) else []:
            if s.getPath().getName() not in used:
                self.files.delete(s.getPath(), True)
                gone += 1
        return gone
