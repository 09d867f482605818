"""Size-tiered compaction of immutable shards under a versioned manifest, with DataFrame operations only.

A run is a folder of shards that nobody changes. Arrivals are runs of small shards; once ``fan_in`` runs
or more have sizes of one tier, all of them are merged into a run of target-sized files, without a shuffle.
Runs may differ in their columns: a merged run has the columns of all, null where a run lacks one; a column
of two types that Parquet can't reconcile is an error before anything is committed. A manifest version names the live runs. It is written aside and renamed into place, which
happens whole or not at all, so that readers see one version or the next. Of two writers that find a
version free at once, the file system lets one folder take the place; the other's goes inside it,
which that writer sees, takes away and fails, so that the store stays as the first one left it. The file
system must rename folders atomically, as HDFS and local ones do and plain object stores don't.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "run string, tier int, path string, bytes long, files long"
_ARRIVAL = "_arrival"
#: Parquet row groups of shards are kept small, as a task holds one while it writes.
_ROW_GROUP = 32 << 20


class ShardStore:
    """A store under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 20):
        self.spark, self.root, self.target_bytes, self.fan_in, self.base_bytes = spark, root, target_bytes, fan_in, base_bytes
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._paths(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files.mkdirs(self._paths(f"{root}/manifests"))

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:]) for s in self._files.listStatus(self._paths(f"{self.root}/manifests")) if s.getPath().getName().startswith("v"))

    def runs(self, version: int | None = None) -> list[dict]:
        """The live runs of a version, by default the last; none before the first commit."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return []
        return [r.asDict() for r in self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifests/v{version:08d}").orderBy("run").collect()]

    def commit(self, runs: list[dict], version: int) -> int:
        """Make ``runs`` the manifest of ``version``; fails if someone else has, and then deletes what only it would have named."""
        own, place = f"_{uuid.uuid4().hex}", f"{self.root}/manifests/v{version:08d}"
        aside = f"{self.root}/manifests/{own}"
        self.spark.createDataFrame([tuple(r[c] for c in ("run", "tier", "path", "bytes", "files")) for r in runs], _MANIFEST).coalesce(1).write.json(aside)
        moved = not self._taken(place) and self._files.rename(self._paths(aside), self._paths(place))
        if not moved or self._files.exists(self._paths(f"{place}/{own}")):
            named = {r["path"] for v in self.versions() for r in self.runs(v)}
            for lost in (aside, f"{place}/{own}", *(r["path"] for r in runs if r["path"] not in named)):
                self._files.delete(self._paths(lost), True)
            raise FileExistsError(f"version {version} was committed by another writer")
        return version

    def _taken(self, place: str) -> bool:
        return self._files.exists(self._paths(place))

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(1, size / self.base_bytes), self.fan_in)))

    def _run(self, name: str, path: str) -> dict:
        found = self._files.getContentSummary(self._paths(path))
        shards = sum(s.getPath().getName().startswith("part-") for s in self._files.listStatus(self._paths(path)))
        return {"run": name, "tier": self.tier(found.getLength()), "path": path, "bytes": found.getLength(), "files": shards}

    def append(self, df: DataFrame, arrivals: int = 1) -> int:
        """Add the rows as ``arrivals`` runs of small shards, dealt by hash in the tasks that read them; the new version."""
        version = max(self.versions(), default=0) + 1
        batch = f"{self.root}/runs/a{version:08d}-{uuid.uuid4().hex[:8]}"
        arrival = max([_ARRIVAL, *df.columns], key=len) + "_"  # longer than any column's name
        hashable = (F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema)  # maps have no hash
        dealt = F.pmod(F.xxhash64(*hashable), F.lit(arrivals)).cast("int")
        df.withColumn(arrival, dealt).write.option("parquet.block.size", _ROW_GROUP).partitionBy(arrival).parquet(batch)
        folders = [s.getPath() for s in self._files.listStatus(self._paths(batch)) if s.isDirectory() and s.getPath().getName().startswith(f"{arrival}=")]
        new = [self._run(f"a{version:08d}-{p.getName().split('=')[1]}", p.toString()) for p in folders]
        return self.commit(self.runs(version - 1) + new, version)

    def _merge(self, runs: list[dict], name: str) -> dict:
        size = sum(r["bytes"] for r in runs)
        path = f"{self.root}/runs/{name}-{uuid.uuid4().hex[:8]}"
        self.spark.read.option("mergeSchema", "true").parquet(*(r["path"] for r in runs)).coalesce(max(1, round(size / self.target_bytes))).write.option("parquet.block.size", _ROW_GROUP).parquet(path)
        return self._run(name, path)

    def compact(self) -> int:
        """Merge tiers of ``fan_in`` runs or more until there is none; each merge commits a version. The last version."""
        version = max(self.versions(), default=0)
        while True:
            runs, tiers = self.runs(version), {}
            for r in sorted(runs, key=lambda r: (r["tier"], r["bytes"], r["run"])):
                tiers.setdefault(r["tier"], []).append(r)
            full = next((rs for _, rs in sorted(tiers.items()) if len(rs) >= self.fan_in), None)
            if full is None:
                return version
            merged = self._merge(full, f"m{version + 1:08d}")
            version = self.commit([r for r in runs if r not in full] + [merged], version + 1)

    def vacuum(self) -> None:
        """Delete the runs that the last version doesn't name; readers of older versions must be done."""
        live = {r["path"] for r in self.runs()}
        for v in self.versions()[:-1]:
            for r in self.runs(v):
                if r["path"] not in live:
                    self._files.delete(self._paths(r["path"]), True)

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version with ``run`` and ``shard``, the number of the file in its run."""
        runs = self.runs(version)
        shard = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
        if not runs:
            return self.spark.createDataFrame([], schema).withColumn("run", F.lit("")).withColumn("shard", F.lit(0))
        folder = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", ""), r"^.*/runs/", "")
        names = F.create_map(*(F.lit(x) for r in runs for x in (r["path"].split("/runs/")[1], r["run"])))
        return self.spark.read.schema(schema).parquet(*(r["path"] for r in runs)).select("*", names[F.url_decode(folder)].alias("run"), shard.alias("shard"))


def shard(docs: DataFrame, root: str, arrivals: int = 8, target_bytes: int = 128 << 20, fan_in: int = 4) -> DataFrame:
    """``docs`` stored under ``root`` and compacted: its rows and columns, with ``run`` and ``shard``.

    Rows are stored whole, nulls and repeats included; what they hold isn't looked at. An empty table
    commits a version without runs and reads back empty. A column of ``docs`` called run or shard gives
    way to the store's.
    """
    plain = docs.drop("run", "shard")
    store = ShardStore(docs.sparkSession, root, target_bytes, fan_in)
    store.append(plain, arrivals)
    store.compact()
    store.vacuum()
    return store.read(plain.schema)
