"""Shared pieces: scratch tables, running totals that do not need one task per key."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, as Java and Python classes read it.
BLANKS = "\\x20\\x09-\\x0D"
WORD = f"[^{BLANKS}]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send tasks' Python up to `rows` rows at a time, unless the session says otherwise: texts are long, and memory is shared."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, rows)


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the cluster names, or the warehouse where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera").rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; `free` removes one, exit removes the rest."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.base = f"{scratch_dir(spark)}/tessera-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: dict[int, tuple[DataFrame, str]] = {}  # holds the tables, so that no other takes over an id
        atexit.register(self.close)

    def path(self) -> str:
        self.count += 1
        return f"{self.base}/{self.count:04d}"

    def cut(self, df: DataFrame) -> DataFrame:
        """`df`, written and read again. Shuffle files of the write go as it ends, since nothing reads them after that."""
        path, key = self.path(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(out)] = out, path
        return out

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def free(self, *tables: DataFrame) -> None:
        """Remove those of `tables` that are cut ones; no plan that is still to run may read them."""
        for table in tables:
            if held := self.tables.pop(id(table), None):
                self._remove(held[1])

    def close(self) -> None:
        try:
            self._remove(self.base)
        except Exception:  # the session has ended first
            pass


def with_estimates(rows: DataFrame, few: DataFrame, keys: list[str], n: int, how: str = "left", most: int = 100_000, salts: int = 64) -> DataFrame:
    """`rows` joined with a table of `n` rows, one for each key: broadcast up to `most`, else with its rows dealt to `salts` places, so that a hot key is spread."""
    if n <= most:
        return rows.join(F.broadcast(few), keys, how)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", F.floor(F.rand(3) * salts).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once for a row, however often `body` uses it."""
    return F.transform(F.array(value), body)[0]


def bucket_bits(rows: int, rows_per_bucket: int = 512, most: int = 20) -> int:
    """Bits that split one key's rows into buckets of about `rows_per_bucket`, if the key held all rows."""
    return max(1, min(most, (max(1, rows) // rows_per_bucket).bit_length()))


def top_bits(hashed: Column, bits: int) -> Column:
    """The highest bits of a signed 64-bit hash: buckets in the hash's own order."""
    return F.shiftright(hashed, 64 - bits)


def running_before(df: DataFrame, keys: list[str], bucket: str, order: list, values: dict[str, str]) -> DataFrame:
    """For each `out: value` of `values` the sum of `value` over the rows of the same keys that come before, by (bucket, order).

    Two levels: totals of buckets are summed per key, and rows only within their bucket, so
    that a key with most of the rows is spread over as many tasks as it has buckets.
    """
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(v).alias(f"_total_{out}") for out, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    earlier = {out: F.coalesce(F.sum(f"_total_{out}").over(before), F.lit(0)) for out in values}
    totals = totals.select(*keys, bucket, *[e.alias(f"_before_{out}") for out, e in earlier.items()])
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({out: F.coalesce(F.sum(v).over(within), F.lit(0)) for out, v in values.items()})
    joined = rows.join(totals, [*keys, bucket])
    return joined.withColumns({out: F.col(out) + F.col(f"_before_{out}") for out in values}).drop(*[f"_before_{out}" for out in values])


def number_rows(scratch: Scratch, df: DataFrame, order: list, out: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in the given order, by ranges: no task sees more than its range."""
    ranged = df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = scratch.cut(ranged)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(out, rank.cast("long") - 1).join(offsets, "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


#: In DuckDB's SQL: the table of CRC-32, as a list `t`, to be named among the CTEs.
CRC_TABLE_SQL = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_sql(value: str) -> str:
    """In DuckDB's SQL the CRC-32 of an ASCII string, where `crc_table` is among the tables."""
    codes = f"list_transform(range(1, length({value}) + 1), lambda k: ord(({value})[k]))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[1 + xor(c & 255, b)])), 4294967295)"
