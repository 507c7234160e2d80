"""Size-tiered compaction of an append-only table with a versioned manifest.

Arrivals are appended as runs: folders of small immutable Parquet shards, one for each write. Runs whose shards are of one
size tier are merged, without a shuffle, into one run of files of the target size. A version of the table is a manifest
file that lists its runs (folder, number of files, bytes, schema, the version that brought it), not their files; there are
some thousands of runs for thousands of appends, however large. A version has the columns of all its runs, in the order in which they came. A version appears by one rename that fails if it exists, so readers see whole
versions and two writers can't both win: HDFS does that in one step, a local file system checks first and then renames, and
an object store needs a committer of its own.
"""

from __future__ import annotations

import json
import math
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

TARGET_BYTES = 64 << 20
#: Runs of one tier differ in the mean size of their shards by less than this factor, and so many shards make a merge.
FANOUT = 4
SMALLEST = 64 << 10


def _nullable(schema: StructType) -> StructType:
    """As Parquet files are read again: columns, and what is in them, may be null."""
    return StructType.fromDDL(schema.toDDL().replace(" NOT NULL", "")) if schema.fields else schema


class Conflict(Exception):
    """Another writer has committed this version."""


class ShardedTable:
    """A table below `path`: data/ holds a folder for each run, manifest/ a file for each version. Version 0 is empty."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.path, self.target, self.fanout = spark, path.rstrip("/"), target_bytes, fanout
        self._jvm = spark._jvm
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # --- versions ---
    def version(self) -> int:
        """The newest version."""
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def runs(self, version: int | None = None) -> list[dict]:
        """{path, files, bytes, schema, since} of a version's runs."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema("line string").text(f"{self.path}/manifest/v{version:010d}.json").toLocalIterator()
        return [json.loads(r[0]) for r in rows if r[0]]

    def commit(self, runs: list[dict], version: int) -> int:
        """Makes `version` of the runs; raises Conflict if it exists already."""
        text = "".join(json.dumps(s, sort_keys=True) + "\n" for s in sorted(runs, key=lambda s: s["path"]))
        own, final = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.path}/manifest/v{version:010d}.json")
        out = self._fs.create(own, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(own), self._fs.makeQualified(final), options)
        except Py4JJavaError as e:
            self._fs.delete(own, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(version) from e
            raise
        return version

    # --- data ---
    def _files(self, folder: str) -> tuple[int, int]:
        """Number and bytes of the shards in a folder."""
        sizes = [f.getLen() for f in self._fs.listStatus(self._path(folder)) if f.getPath().getName().startswith("part-")]
        return len(sizes), sum(sizes)

    def _run(self, folder: str, schema: StructType, since: int) -> list[dict]:
        """The run that a finished write left in a folder; none if it has no file."""
        files, size = self._files(folder)
        return [{"path": folder, "files": files, "bytes": size, "schema": schema.jsonValue(), "since": since}] if files else []

    def schema(self, runs: list[dict]) -> StructType:
        """The columns of all runs, older ones first; raises TypeError where two runs give one name different types or spellings."""
        found: dict[str, StructField] = {}
        for r in sorted(runs, key=lambda r: (r["since"], r["path"])):
            for field in StructType.fromJson(r["schema"]).fields:
                had = found.setdefault(field.name.lower(), StructField(field.name, field.dataType))
                if (had.name, had.dataType) != (field.name, field.dataType):
                    raise TypeError(f"column {field.name} {field.dataType.simpleString()} is {had.name} {had.dataType.simpleString()} already")
        return StructType(list(found.values()))

    def append(self, arrivals: DataFrame) -> int:
        """One more version, with the arrivals as a run of its own: a shard for each of their partitions. Without rows the run is empty.

        Columns that older runs lack are null in those, and the other way round. A column whose type differs is refused (TypeError) before anything is written."""
        folder, base = f"{self.path}/data/{uuid.uuid4().hex}", self.version()
        self._fits(base, arrivals.schema)
        arrivals.write.option("compression", "zstd").parquet(folder)
        return self.commit(self.runs(base) + self._run(folder, _nullable(arrivals.schema), base + 1), base + 1)

    def _fits(self, version: int, schema: StructType) -> None:
        self.schema([*self.runs(version), {"schema": _nullable(schema).jsonValue(), "since": version + 1, "path": ""}])

    def append_by(self, arrivals: DataFrame, batch_col: str) -> int:
        """Appends each batch as a run of its own, all written by one job and committed as one version, or not at all. batch_col isn't kept."""
        folder, base = f"{self.path}/data/{uuid.uuid4().hex}", self.version()
        kept = _nullable(arrivals.drop(batch_col).schema)
        self._fits(base, kept)
        arrivals.write.partitionBy(batch_col).option("compression", "zstd").parquet(folder)
        batches = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory() and "=" in s.getPath().getName())
        return self.commit(self.runs(base) + [r for b in batches for r in self._run(f"{folder}/{b}", kept, base + 1)], base + 1)

    def tier(self, size: float) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fanout)) + 1)

    def due(self, runs: list[dict]) -> list[dict]:
        """Runs to merge next: the lowest tier in which those with shards below half the target size have `fanout` shards together."""
        tiers: dict[int, list[dict]] = {}
        for r in runs:
            if 2 * r["bytes"] <= self.target * r["files"]:
                tiers.setdefault(self.tier(r["bytes"] / r["files"]), []).append(r)
        return next((t for _, t in sorted(tiers.items()) if sum(r["files"] for r in t) >= self.fanout), [])

    def _read(self, session: SparkSession, runs: list[dict]) -> DataFrame:
        # folders around a run aren't columns; a file that lacks a column has nulls there
        return session.read.schema(self.schema(runs)).option("recursiveFileLookup", "true").parquet(*(r["path"] for r in runs))

    def compact(self) -> int:
        """Merges tier after tier until none is due; each merge is a version. Old runs stay for readers of old versions."""
        while True:
            base = self.version()
            runs = self.runs(base)
            merge = self.due(runs)
            if not merge:
                return base
            # a task reads whole shards up to the target size and writes one file
            session = self.spark.newSession()
            for key, value in (("maxPartitionBytes", self.target), ("openCostInBytes", 1), ("minPartitionNum", 1)):
                session.conf.set(f"spark.sql.files.{key}", str(value))
            folder = f"{self.path}/data/{uuid.uuid4().hex}"
            self._read(session, merge).write.option("compression", "zstd").parquet(folder)
            merged = self._run(folder, self.schema(merge), min(r["since"] for r in merge))
            gone = {r["path"] for r in merge}
            self.commit([r for r in runs if r["path"] not in gone] + merged, base + 1)
            if sum(r["files"] for r in merged) >= sum(r["files"] for r in merge):  # nothing was won; don't try again
                return base + 1

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. An empty version has no schema and raises ValueError."""
        runs = self.runs(version)
        if not runs:
            raise ValueError("the table is empty")
        return self._read(self.spark, runs)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes runs that none of the newest `keep` versions lists, and returns how many. Don't run it beside a writer."""
        newest = self.version()
        used = {r["path"] for v in range(max(1, newest - keep + 1), newest + 1) for r in self.runs(v)}
        found = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.path}/data"))]
        old = []
        for p in found:
            name = f"{self.path}/data/{p.getName()}"
            inner = [f"{name}/{s.getPath().getName()}" for s in self._fs.listStatus(p) if s.isDirectory()]
            old += [r for r in inner or [name] if r not in used]
        for r in old:
            self._fs.delete(self._path(r), True)
        return len(old)
