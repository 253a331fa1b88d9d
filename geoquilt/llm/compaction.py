"""Size-tiered compaction of a table of immutable shards, with a versioned manifest.

A shard is one Parquet file that never changes. Arrivals are appended as small shards. The
compactor puts shards below the target size into tiers by the power of FANOUT that their size
reaches; a tier that holds FANOUT or more is merged into files near the target size, which may
fill a higher tier in turn. A row is thus rewritten a logarithmic number of times. Files are
merged by reading them into as many tasks as files are to come: no shuffle, and no task that
holds more than about one target.

The manifest of a version lists its shards. It is written aside and moved to its name by a
rename that fails if the name exists, so that a version appears whole or not at all; of two
writers one has to try again, which append() and compact() do. The shared folder has to rename
atomically, as HDFS and local file systems do; plain object stores don't. vacuum() removes what
only versions that are no longer kept list, and files that no version lists once they are older
than any writer runs; commit() refuses shards whose files are gone.

Rows are kept as they are: nulls, repeated rows, very long ones and any columns. An empty table
has no rows in its shards and reads as an empty table of its schema.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoquilt.llm.common import filesystem

TARGET_BYTES = 128 << 20
#: Shards of a tier that are merged; the size of tier 0's largest; the share of the target from
#: which a shard is left alone.
FANOUT, LEAST_BYTES, FULL = 4, 1 << 20, 0.75
#: Seconds after which a file that no version lists is taken for a failed writer's.
ORPHAN_AGE = 7 * 24 * 3600


@dataclass(frozen=True)
class Shard:
    file: str
    bytes: int


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def tier(size: int, fanout: int = FANOUT, least: int = LEAST_BYTES) -> int:
    return max(0, math.floor(math.log(max(size, 1) / least, fanout)) + 1)


def due(shards: list[Shard], target: int, fanout: int = FANOUT) -> list[list[Shard]]:
    """The members of each tier that is to be merged, lowest tier first."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.bytes < FULL * target:
            tiers.setdefault(tier(s.bytes, fanout), []).append(s)
    # so many must leave fewer files than they are
    return [
        sorted(members, key=lambda s: s.file)
        for _, members in sorted(tiers.items())
        if len(members) >= fanout and len(members) > files_of(members, target)
    ]


def files_of(shards: list[Shard], target: int) -> int:
    return max(1, round(sum(s.bytes for s in shards) / target))


class ShardStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs, self.cls = filesystem(spark, path)

    # manifest

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/v{version:010d}.json"

    def version(self) -> int:
        """0 if nothing has been committed."""
        folder = self.cls(f"{self.path}/manifest")
        if not self.fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self.cls(self._manifest(version)))
        try:
            jvm = self.spark.sparkContext._jvm
            return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self.manifest(version)["shards"]]

    def commit(self, base: int, shards: list[Shard], schema: T.StructType) -> int:
        """The version after `base`; Conflict if there is one already. FileNotFoundError if the
        file of a shard that `base` doesn't list is gone."""
        if base and not self.fs.exists(self.cls(self._manifest(base))):
            raise Conflict(f"version {base} is not kept any more")
        known = {s.file for s in self.shards(base)} if base else set()
        for s in shards:
            if s.file not in known and not self.fs.exists(self.cls(s.file)):
                raise FileNotFoundError(s.file)
        context = self.spark.sparkContext
        jvm = context._jvm
        body = json.dumps({"version": base + 1, "schema": schema.jsonValue(), "shards": [asdict(s) for s in shards]})
        aside = self.cls(f"{self.path}/manifest/.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(aside)
        stream.write(bytearray(body.encode()))
        stream.close()
        options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), context._jsc.hadoopConfiguration())
        try:
            files.rename(aside, self.cls(self._manifest(base + 1)), options)
        except Exception as e:
            self.fs.delete(aside, False)
            if "FileAlreadyExists" in str(e) or self.version() > base:
                raise Conflict(f"version {base + 1} exists") from e
            raise
        return base + 1

    # data

    def _written(self, folder: str) -> list[Shard]:
        out, walk = [], self.fs.listFiles(self.cls(folder), True)
        while walk.hasNext():
            status = walk.next()
            if status.getPath().getName().startswith("part-"):
                out.append(Shard(status.getPath().toString(), status.getLen()))
        return sorted(out, key=lambda s: s.file)

    def append(self, rows: DataFrame) -> int:
        """One arrival as new shards; the version that has it."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        new = self._written(folder)
        while True:
            base = self.version()
            try:
                return self.commit(base, self.shards(base) + new, rows.schema)
            except Conflict:
                continue  # another arrival was first

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
        """Merges tiers until none is due, those that are due at once side by side; each such
        round is a version. Returns the last."""
        while True:
            now = self.manifest()
            groups = due([Shard(**s) for s in now["shards"]], target, fanout)
            if not groups:
                return now["version"]
            schema = T.StructType.fromJson(now["schema"])

            def merged(members: list[Shard]) -> list[Shard]:
                folder = f"{self.path}/data/{uuid.uuid4().hex}"
                self._frame(members, schema).coalesce(files_of(members, target)).write.parquet(folder)  # noqa: B023
                return self._written(folder)

            with ThreadPool(min(len(groups), 4)) as pool:
                new = [s for shards in pool.map(merged, groups) for s in shards]
            self._replace({s.file for members in groups for s in members}, new)

    def _replace(self, gone: set[str], new: list[Shard]) -> None:
        """Commits `new` in place of the shards `gone`, on top of what others have appended. If
        another compactor was first, the files are dropped."""
        while True:
            now = self.manifest()
            held = [Shard(**s) for s in now["shards"]]
            if not gone <= {s.file for s in held}:
                for s in new:
                    self.fs.delete(self.cls(s.file), False)
                return
            try:
                self.commit(now["version"], [s for s in held if s.file not in gone] + new, T.StructType.fromJson(now["schema"]))
                return
            except Conflict:
                continue

    def _frame(self, shards: list[Shard], schema: T.StructType) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.file for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        now = self.manifest(version)
        if now["schema"] is None:
            raise ValueError("nothing has been committed")
        return self._frame([Shard(**s) for s in now["shards"]], T.StructType.fromJson(now["schema"]))

    def vacuum(self, keep: int = 1, orphan_age: float = ORPHAN_AGE) -> int:
        """Removes files that earlier versions list and the last `keep` don't, these versions,
        and files older than `orphan_age` seconds that none lists; how many files. A writer that
        hasn't committed yet keeps its files; readers of a version that isn't kept lose it."""
        last = self.version()
        oldest = max(1, last - keep + 1)
        listed = {s.file for v in range(oldest, last + 1) for s in self.shards(v)}
        former = [v for v in range(oldest - 1, 0, -1) if self.fs.exists(self.cls(self._manifest(v)))]
        gone = {s.file for v in former for s in self.shards(v)} - listed
        before = (time.time() - orphan_age) * 1000
        walk = self.fs.listFiles(self.cls(f"{self.path}/data"), True) if self.fs.exists(self.cls(f"{self.path}/data")) else None
        while walk is not None and walk.hasNext():
            status = walk.next()
            if status.getModificationTime() < before and status.getPath().toString() not in listed:
                gone.add(status.getPath().toString())
        removed = sum(bool(self.fs.delete(self.cls(file), False)) for file in sorted(gone))
        for v in former:
            self.fs.delete(self.cls(self._manifest(v)), False)
        return removed
