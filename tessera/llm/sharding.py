"""Operator 8: size-tiered compaction of small immutable shards, under a versioned manifest.

Each arrival is appended as shards of its own. Shards of about one size form a tier; when a tier
has enough of them, runs of it are merged into shards of up to the target size, until no tier is
full; all merges of a round are one job, a task for each run. A commit creates the next version of
the manifest by a rename that fails where the name is taken, so that of two writers only one
succeeds; readers see one version or the next, never parts of both.

The driver handles the list of shards alone; rows are read and written by Spark's own sources.
"""

from __future__ import annotations

import functools
import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import Scratch, documents


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class SchemaConflict(ValueError):
    """An arrival has a column of the table with another type, or with its name spelled in another case."""


def merged_schema(held: StructType | None, new: StructType) -> StructType:
    """The columns of the table, then those that are new; all may be null, as shards that lack a column have nulls there."""
    fields = {f.name: f.dataType for f in held.fields} if held else {}
    spelled = {name.lower(): name for name in fields}
    for f in new.fields:
        name = spelled.setdefault(f.name.lower(), f.name)
        if name != f.name or fields.setdefault(name, f.dataType) != f.dataType:
            raise SchemaConflict(f"column {f.name} of type {f.dataType.simpleString()} is {name} of type {fields[name].simpleString()} in the table")
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


class ShardedTable:
    """root/data/<run>/part-*.parquet, root/manifest/<version>.json and root/intent/<run>.

    A version lists its shards with their bytes, and those that it took out of the version
    before. An intent stands from before a run is written until its shards are committed or
    given up; `vacuum` leaves such runs alone. Rows keep all their columns, nulls and
    repetitions; an empty arrival adds a version without shards. The table has the columns of all its
    arrivals, with nulls where an arrival had none; one with another type is refused. Two writers need a file system
    whose rename without overwriting is atomic, as that of HDFS is.
    """

    def __init__(self, spark: SparkSession, root: str, *, target_bytes: int = 128 << 20, fan_in: int = 4, base_bytes: int = 1 << 20, grace_seconds: int = 86_400, attempts: int = 8):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.base_bytes = target_bytes, fan_in, base_bytes
        self.grace_seconds, self.attempts = grace_seconds, attempts
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _list(self, folder: str) -> list:
        path = self._path(folder)
        return list(self._fs.listStatus(path)) if self._fs.exists(path) else []

    def version(self) -> int:
        """The latest committed version; 0 before the first."""
        names = [s.getPath().getName() for s in self._list(f"{self.root}/manifest")]
        return max([0, *(int(n[:-5]) for n in names if n.endswith(".json"))])

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": None, "shards": []}
        stream = self._fs.open(self._path(f"{self.root}/manifest/{version:010d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, draft, final) -> None:
        """Rename, unless the name is taken."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
        context.rename(draft, final, options)

    def _commit(self, base: dict, schema: StructType, added: list[dict], removed: set[str] = frozenset()) -> int:
        """The version after `base`: its shards without `removed`, and `added`, whose files must be there."""
        for shard in added:
            if not self._fs.exists(self._path(f"{self.root}/{shard['path']}")):
                raise FileNotFoundError(shard["path"])
        version, folder, writer = base["version"] + 1, f"{self.root}/manifest", uuid.uuid4().hex
        schema = merged_schema(StructType.fromJson(base["schema"]) if base["schema"] else None, schema)
        shards = [s for s in base["shards"] if s["path"] not in removed] + added
        content = json.dumps({"version": version, "schema": schema.jsonValue(), "shards": shards, "removed": sorted(removed), "writer": writer})
        self._fs.mkdirs(self._path(folder))
        draft, final = (self._fs.makeQualified(self._path(f"{folder}/{name}")) for name in (f".{uuid.uuid4().hex}", f"{version:010d}.json"))
        stream = self._fs.create(draft, False)
        stream.write(bytearray(content.encode()))
        stream.close()
        try:
            self._publish(draft, final)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                if self.manifest(version).get("writer") == writer:
                    return version  # the rename was done, and only its answer was lost
                raise CommitConflict(f"version {version} of {self.root} is there") from error
            raise
        return version

    def _begin(self) -> str:
        run = uuid.uuid4().hex
        self._fs.create(self._path(f"{self.root}/intent/{run}"), False).close()
        return run

    def _end(self, run: str, failed: bool | None = False) -> None:
        """Take back a run's intent, and its data if it failed; None, where nobody knows whether its commit was made, leaves both to `vacuum`."""
        if failed is None:
            return
        if failed:
            self._fs.delete(self._path(f"{self.root}/data/{run}"), True)
        self._fs.delete(self._path(f"{self.root}/intent/{run}"), False)

    def _write(self, run: str, rows: DataFrame) -> list[dict]:
        folder = f"{self.root}/data/{run}"
        rows.write.option("compression", "zstd").parquet(folder)
        found = [(s.getPath().getName(), s.getLen()) for s in self._list(folder)]
        return [{"path": f"data/{run}/{name}", "bytes": size, "run": run} for name, size in found if name.endswith(".parquet")]

    def append(self, rows: DataFrame) -> int:
        """One arrival as shards of its own; none of its files is ever changed. If another writer commits first, the shards go into the version after."""
        held = self.manifest()["schema"]
        merged_schema(StructType.fromJson(held) if held else None, rows.schema)
        run, failed = self._begin(), True
        try:
            shards = self._write(run, rows)
            for attempt in range(self.attempts):
                try:
                    failed = None
                    version = self._commit(self.manifest(), rows.schema, shards)
                    failed = False
                    return version
                except SchemaConflict:
                    failed = True
                    raise
                except CommitConflict:
                    failed = True
                    if attempt + 1 == self.attempts:
                        raise
        finally:
            self._end(run, failed)

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.base_bytes, self.fan_in))) if size > self.base_bytes else 0

    def _runs(self, shards: list[dict]) -> list[list[dict]]:
        """Sets of shards to merge: of every tier below the target with `fan_in` or more, in runs of up to the target."""
        tiers: dict[int, list[dict]] = {}
        for shard in shards:
            if shard["bytes"] < self.target_bytes / 2:
                tiers.setdefault(self.tier(shard["bytes"]), []).append(shard)
        runs = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fan_in:
                continue
            run, held = [], 0
            for shard in sorted(members, key=lambda s: (s["bytes"], s["path"])):
                if run and held + shard["bytes"] > self.target_bytes:
                    runs.append(run)
                    run, held = [], 0
                run.append(shard)
                held += shard["bytes"]
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def compact(self, runs_a_job: int = 500) -> int:
        """Merge until no tier is full; each round is one job and one commit. Returns the version that holds then.

        Of a round up to `runs_a_job` runs are merged, the next round takes the others. A round that
        loses its commit to another writer is given up, and the next begins from that version.
        """
        lost = 0
        while True:
            base = self.manifest()
            runs = self._runs(base["shards"])[:runs_a_job]
            if not runs:
                return base["version"]
            schema, failed, run = StructType.fromJson(base["schema"]), True, self._begin()
            try:
                reader = self.spark.read.schema(schema)
                parts = [reader.parquet(*[f"{self.root}/{s['path']}" for s in members]).coalesce(1) for members in runs]
                merged = self._write(run, functools.reduce(DataFrame.unionAll, parts))
                failed = None
                self._commit(base, schema, merged, {s["path"] for members in runs for s in members})
                failed = False
            except CommitConflict:
                failed = True
                lost += 1
                if lost == self.attempts:
                    raise
            finally:
                self._end(run, failed)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, each with `_shard`, the path of its shard; a column of that name comes first, under its name with a further `_`."""
        held = self.manifest(version)
        if held["schema"] is None:
            raise ValueError(f"{self.root} has no version")
        schema = StructType.fromJson(held["schema"])
        paths = [f"{self.root}/{s['path']}" for s in held["shards"]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        own = rows.withColumnRenamed("_shard", "__shard")
        return own.withColumn("_shard", F.regexp_extract(F.input_file_name(), r"(data/[^/]+/[^/]+)$", 1))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete data that none of the last versions lists; returns how many files went.

        What a version took out goes at once, with the manifests before it. Runs that no version
        has listed go only if they are older than `grace_seconds` and have no intent, as their
        writer may be about to commit; an intent older than that is that of a writer that died.
        """
        latest = self.version()
        oldest = max(1, latest - keep_versions + 1)
        kept = {s["path"] for v in range(oldest, latest + 1) for s in self.manifest(v)["shards"]}
        names = sorted(s.getPath().getName() for s in self._list(f"{self.root}/manifest"))
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        gone = 0
        for version in (v for v in versions if v <= oldest):
            for path in self.manifest(version).get("removed", ()):
                if path not in kept:
                    gone += bool(self._fs.delete(self._path(f"{self.root}/{path}"), False))
        late = time.time() * 1000 - self.grace_seconds * 1000
        busy = {s.getPath().getName() for s in self._list(f"{self.root}/intent") if s.getModificationTime() > late}
        listed = {p.split("/")[1] for v in versions for p in (s["path"] for s in self.manifest(v)["shards"])}
        for folder in self._list(f"{self.root}/data"):
            run = folder.getPath().getName()
            if run not in busy and run not in listed and folder.getModificationTime() < late:
                gone += sum(s.getPath().getName().endswith(".parquet") for s in self._list(f"{self.root}/data/{run}"))
                self._end(run, failed=True)
        for version in (v for v in versions if v < oldest):
            self._fs.delete(self._path(f"{self.root}/manifest/{version:010d}.json"), False)
        return gone


def arrivals(docs: DataFrame, n: int) -> list[DataFrame]:
    """The rows in up to `n` ranges of doc_id, null first; an id of another type than an integer is dealt by its hash."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        return [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k) for k in range(n)]
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return [docs]
    step = max(1, -(-(high - low + 1) // n))
    parts = []
    for k, start in enumerate(range(low, high + 1, step)):
        inside = (F.col("doc_id") >= start) & (F.col("doc_id") < start + step)
        parts.append(docs.where(inside | F.col("doc_id").isNull()) if k == 0 else docs.where(inside))
    return parts


def op8_tiered_shards(spark: SparkSession, sf_dir: str, *, n_arrivals: int = 6) -> DataFrame:
    """Every document with the shard that holds it after `n_arrivals` appends, each followed by compaction."""
    scratch = Scratch(spark)
    table = ShardedTable(spark, scratch.path())
    for part in arrivals(documents(spark, sf_dir), n_arrivals):
        table.append(part)
        table.compact()
        table.vacuum()
    held = {s["path"]: s["bytes"] for s in table.manifest()["shards"]}
    sizes = spark.createDataFrame(list(held.items()), "_shard string, shard_bytes long")
    size = F.length(F.coalesce("text", F.lit("")).cast("binary")).cast("long")
    rows = table.read().select("doc_id", "_shard", size.alias("n_bytes"))
    return rows.join(sizes, "_shard").select("doc_id", "n_bytes", F.col("_shard").alias("shard"), "shard_bytes", F.lit(table.version()).cast("long").alias("version"))
