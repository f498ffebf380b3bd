"""Writers: staged files, unique appends, content-addressed artifacts, snapshots."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .locks import exclusive


class AppendRejected(ValueError):
    """A batch that an append does not take; nothing of it is written."""


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def replace_folder(spark: SparkSession, staged: str, final: str, *, attempts: int = 4, wait: float = 0.2) -> None:
    """Put a staged folder in the place of another, which it replaces only once it is complete.

    Between two renames the place is empty for a moment; a reader that finds nothing there has to
    look again. If the second fails `attempts` times, with longer waits between them, the old folder comes back.
    Where readers must never find the place empty, use `publish_version`.
    """
    fs, source = _fs(spark, staged)
    _, target = _fs(spark, final)
    _, old = _fs(spark, f"{final}.old-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    if fs.exists(target):
        fs.rename(target, old)
    for attempt in range(attempts):
        if fs.rename(source, target):
            break
        time.sleep(wait * 2**attempt)
    else:
        fs.rename(old, target)
        raise OSError(f"cannot move {staged} to {final}")
    fs.delete(old, True)


def write_staged(df: DataFrame, path: str, kind: str = "json", **options) -> None:
    """Write beside the path, then take its place (JSON lines, CSV with a header, Parquet)."""
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    options = {"header": True, **options} if kind == "csv" else options
    df.write.format(kind).options(**options).save(staged)
    replace_folder(df.sparkSession, staged, path)


def _rename_strictly(spark: SparkSession, source: str, target: str) -> bool:
    """Rename in one step; False where the target is there already, whoever made it."""
    jvm = spark._jvm
    src, dst = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.getFileSystem(spark._jsc.hadoopConfiguration()).getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(src, dst, none)
    except Exception:
        if files.util().exists(dst):
            return False
        raise
    return True


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions of a table below `path`, ascending."""
    fs, target = _fs(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v-"))


def _version(path: str, number: int) -> str:
    return f"{path.rstrip('/')}/v-{number:012d}"


def publish_version(df: DataFrame, path: str, number: int, *, keep: int = 3) -> bool:
    """Write `df` as version `number` of the table at `path`; False, and nothing, where that number is taken.

    A version appears whole by one rename, and the one before stays for those who read it; all but
    the last `keep` go. There is no moment without a table.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    taken = _rename_strictly(spark, staged, _version(path, number))
    fs, rest = _fs(spark, staged)
    fs.delete(rest, True)
    for old in versions(spark, path)[:-keep]:
        fs.delete(_fs(spark, _version(path, old))[1], True)
    return taken


def read_version(spark: SparkSession, path: str, schema: str, number: int | None = None) -> DataFrame:
    """A version of the table at `path`, the last one unless told; empty where there is none."""
    known = versions(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_version(path, known[-1] if number is None else number))


def write_document(df: DataFrame, path: str, *, most_rows: int = 10_000) -> None:
    """A small table (up to `most_rows`) as one readable JSON document."""
    rows = [json.loads(r) for r in (x[0] for x in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most_rows + 1).collect())]
    if len(rows) > most_rows:
        raise ValueError(f"a document holds up to {most_rows} rows")
    fs, target = _fs(df.sparkSession, path)
    stream = fs.create(target, True)
    stream.write(bytearray(json.dumps(rows, indent=2, ensure_ascii=False).encode()))
    stream.close()


def unique_append(new: DataFrame, path: str, key: str, *, problem=None, most_rows: int | None = None) -> int:
    """Append rows whose key is neither null, repeated nor there; a broken rule rejects the whole batch.

    `problem` is a column with a reason or null. Writers take turns by a lock beside the path;
    one that finds it held gets `Locked`. Readers see whole files only.
    """
    with exclusive(new.sparkSession, f"{path.rstrip('/')}.lock"):
        return _append(new, path, key, problem, most_rows)


def _append(new: DataFrame, path: str, key: str, problem, most_rows: int | None) -> int:
    spark = new.sparkSession
    rows = new.withColumn("_problem", problem if problem is not None else F.lit(None).cast("string")).cache()
    try:
        n, bad, nulls, distinct = rows.agg(F.count("*"), F.first("_problem", ignorenulls=True), F.count_if(F.col(key).isNull()), F.count_distinct(key)).first()
        if bad or nulls or distinct != n:
            raise AppendRejected(bad or ("a key is null" if nulls else "a key repeats in the batch"))
        have = 0
        if _exists(spark, path):
            there = spark.read.schema(new.schema).json(path)
            if not rows.join(there.select(key), key, "left_semi").isEmpty():
                raise AppendRejected("a key is there")
            have = there.count()
        if most_rows is not None and have + n > most_rows:
            raise AppendRejected(f"{most_rows} rows are the limit")
        rows.drop("_problem").write.mode("append").json(path)
        return n
    finally:
        rows.unpersist()


def put_artifacts(rows: DataFrame, path: str) -> DataFrame:
    """Write dataset, kind, content (canonical JSON) under their digest, those not there yet; gives all references."""
    spark = rows.sparkSession
    addressed = rows.select("dataset", "kind", "content", F.sha2("content", 256).alias("digest")).dropDuplicates(["dataset", "kind", "digest"])
    fresh = addressed
    if _exists(spark, path):
        fresh = addressed.join(spark.read.parquet(path).select("dataset", "kind", "digest"), ["dataset", "kind", "digest"], "left_anti")
    fresh.write.mode("append").partitionBy("dataset", "kind").parquet(path)
    return addressed.select("dataset", "kind", "digest")


def get_artifacts(spark: SparkSession, references: DataFrame, path: str) -> DataFrame:
    """References with their content and `valid`: there, and its digest is that asked for."""
    found = references.join(spark.read.parquet(path), ["dataset", "kind", "digest"], "left")
    return found.withColumn("valid", F.coalesce(F.sha2("content", 256) == F.col("digest"), F.lit(False)))


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)
