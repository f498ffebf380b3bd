"""Readers of JSON lines, documents, CSV, event folders, media files and configuration."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def _schema(schema: str | StructType) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, *, strict: bool = True) -> DataFrame:
    """Rows of JSON lines; a byte-order mark and blank lines are no rows, a missing path is empty.

    strict: a line that is no object of the schema fails the read. Otherwise it is left out.
    """
    schema = _schema(schema)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    mode = "FAILFAST" if strict else "PERMISSIVE"
    corrupt = StructType([*schema.fields]).add("_corrupt", "string")
    parsed = lines.select("value", F.from_json("value", schema if strict else corrupt, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    whole = F.trim("value").startswith("{")
    if strict:
        checked = F.when(whole, F.col("r")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 80))).cast(schema))
        return parsed.select(checked.alias("r")).select("r.*")
    kept = parsed.where(whole & F.col("r").isNotNull() & F.col("r._corrupt").isNull())
    return kept.select(*[F.col(f"r.`{f.name}`").alias(f.name) for f in schema.fields])


def read_json_values(spark: SparkSession, path: str) -> DataFrame:
    """value: every valid JSON line as VARIANT, objects or not; other lines are left out."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "value string").select(F.parse_json("value").alias("value"))
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias("value")).where("value is not null")


def read_document_rows(spark: SparkSession, path: str, field: str, schema: str | StructType, *, also: list[str] = ()) -> DataFrame:
    """The rows of the array `field` of JSON documents, one a file, with `ordinal`, their place in it; `also`: columns that folders name."""
    whole = spark.read.schema(StructType([StructField(field, ArrayType(_schema(schema))), *[StructField(c, StringType()) for c in also]])).json(path, multiLine=True)
    return whole.select(*also, F.posexplode(field).alias("ordinal", "r")).select(*also, "ordinal", "r.*")


def read_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """CSV with a header, compressed or not; strings unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(_schema(schema)) if schema else reader).csv(path)


def last_by_key(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """A lookup in which a later row of a key replaces an earlier one."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ordinal)))
    return rows.withColumn("_k", rank).where("_k = 1").drop("_k")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, offset, value: each line with the byte at which it begins, however the file is split among tasks.

    Lines end at `\\n` (a carriage return stays in the value). A task counts the bytes of each of its splits as they
    come by; what the splits before it hold is one row a split, summed file by file. The files are
    read twice, and no line is shuffled. A byte-order mark counts and is part of the first line.
    """
    lines = spark.read.option("lineSep", "\n").text(paths)
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    lines = lines.select(*meta, "value", (F.octet_length("value") + 1).cast("long").alias("size"))
    totals = lines.groupBy("file", "split").agg(F.sum("size").alias("bytes"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    later = totals.withColumn("before", F.sum("bytes").over(before)).where("before is not null").select("file", "split", "before")

    def placed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        current, at = None, 0
        for batch in batches:
            keys = list(zip(batch.column("file").to_pylist(), batch.column("split").to_pylist()))
            sizes, starts = batch.column("size").to_pylist(), []
            for key, size in zip(keys, sizes):
                current, at = (key, at) if key == current else (key, 0)
                starts.append(at)
                at += size
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("split"), pa.array(starts, pa.int64()), pc.cast(batch.column("value"), pa.string())], names=["file", "split", "start", "value"])

    read = lines.mapInArrow(placed, "file string, split long, start long, value string")
    joined = read.join(later, ["file", "split"], "left")
    return joined.select("file", (F.col("start") + F.coalesce("before", F.lit(0))).alias("offset"), "value")


def read_events(spark: SparkSession, roots: list[str], schema: str | StructType, *, place: bool = False) -> DataFrame:
    """Events of `events.jsonl` and `events/*.jsonl` (or `.json`) below each root, each file once, with `event_file`.

    place: also `offset`, the byte at which an event's line begins, so that (event_file, offset) is the order
    in which a file's writer put them.
    """
    paths = sorted({p for r in roots for p in (f"{r}/events.jsonl", f"{r}/events/*.jsonl", f"{r}/events/*.json") if path_exists(spark, p)})
    if not paths:
        empty = spark.createDataFrame([], _schema(schema)).withColumn("event_file", F.lit(""))
        return empty.withColumn("offset", F.lit(0).cast("long")) if place else empty
    if place:
        lines, extra = read_lines(spark, paths).withColumnRenamed("file", "event_file"), ["event_file", "offset"]
    else:
        lines, extra = spark.read.text(paths).select("value", F.input_file_name().alias("event_file")), ["event_file"]
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    return lines.select(F.from_json("value", _schema(schema)).alias("r"), *extra).where("r is not null").select("r.*", *extra)


def shard_roots(spark: SparkSession, root: str) -> list[str]:
    """Folders `shard_*` below the root, or the root itself."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/shard_*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().toString() for s in found or ()) or [root]


def list_files(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """path, length, modified of all files below the root with one of the extensions (case ignored); Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin([e.lower().lstrip(".") for e in extensions]))


def file_digests(spark: SparkSession, root: str, *, most_whole: int = 2**28, open_file: Callable[[str], object] | None = None) -> DataFrame:
    """path, sha256 of files below the root (empty ones are not listed).

    Files up to `most_whole` bytes are hashed as values. Larger ones are read by chunks of 8 MB in the task, by
    `open_file(path)` where their folder needs a client of its own, else by the file systems that Arrow knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    small = files.load(root).where(F.col("length") <= most_whole).select("path", F.sha2("content", 256).alias("sha256"))
    large = files.load(root).where(F.col("length") > most_whole).select("path")
    return small.unionByName(large.repartition("path").mapInPandas(_chunked_digests(open_file), "path string, sha256 string"))


def _chunked_digests(open_file):
    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyarrow import fs

        def opened(path: str):
            if open_file is not None:
                return open_file(path)
            system, inner = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
            return system.open_input_stream(inner)

        for frame in frames:
            digests = []
            for path in frame["path"]:
                digest = hashlib.sha256()
                with opened(path) as stream:
                    while chunk := stream.read(2**23):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pd.DataFrame({"path": frame["path"], "sha256": digests})

    return run


def probe_media(files: DataFrame, probe: Callable[[str], dict], schema: str) -> DataFrame:
    """`path` and the fields that an injected `probe(path)` gives, with `probe_error`; a failing probe gives nulls and its message."""
    import pandas as pd

    names = [f.name for f in _schema(schema).fields]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path in frame["path"]:
                try:
                    got = probe(path)
                    out.append({"path": path, **{n: got.get(n) for n in names}, "probe_error": None})
                except Exception as e:  # whatever a probe meets is a result here
                    out.append({"path": path, **dict.fromkeys(names), "probe_error": f"{type(e).__name__}: {e}"[:200]})
            yield pd.DataFrame(out, columns=["path", *names, "probe_error"])

    return files.select("path").mapInPandas(run, f"path string, {schema}, probe_error string")


def load_verified(path: str, digest: str) -> bytes:
    """A local configuration file's bytes, if they have the digest."""
    with open(path, "rb") as f:
        content = f.read()
    if hashlib.sha256(content).hexdigest() != digest:
        raise ValueError(f"{path} does not have the expected digest")
    return content


def verified_files(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """name, content, sha256, problem: files below the root against a policy table `expected` (name, sha256).

    A name is a file's path below the root. Problems: `missing`, `digest differs`, or `unexpected` for a file that the table
    does not know; content is given only where there is none. A name that the table repeats is checked each time.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    found = files.select(F.expr("substring(path, {})".format(len(base) + 1)).alias("_name"), "content", F.sha2("content", 256).alias("_found"))
    both = expected.select("name", "sha256").join(found, F.col("name") == F.col("_name"), "full")
    problem = F.when(F.col("_name").isNull(), "missing").when(F.col("name").isNull(), "unexpected").when(~F.col("sha256").eqNullSafe(F.col("_found")), "digest differs")
    both = both.withColumn("problem", problem)
    return both.select(F.coalesce("name", "_name").alias("name"), F.when(F.col("problem").isNull(), F.col("content")).alias("content"), F.col("_found").alias("sha256"), "problem")


def load_policies(spark: SparkSession, root: str, expected: DataFrame) -> DataFrame:
    """name, content as text: all files of a policy, none of which may be missing, changed or unknown."""
    checked = verified_files(spark, root, expected)
    wrong = checked.where("problem is not null").select("name", "problem").limit(5).collect()
    if wrong:
        raise ValueError("policy: " + ", ".join(f"{r['name']}: {r['problem']}" for r in wrong))
    return checked.select("name", F.decode("content", "UTF-8").alias("content"))


def yaml_rows(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """Rows of a YAML list of mappings (a small configuration)."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML needs PyYAML") from e
    names = [f.name for f in _schema(schema).fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in yaml.safe_load(text) or []], schema)
