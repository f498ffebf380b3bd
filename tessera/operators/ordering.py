"""Global orders without one task for all rows: ranges for any order, turns for interleaved ones."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete a folder of the library's own as the driver ends, if its session still runs then."""

    def remove() -> None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended first
            pass

    atexit.register(remove)


def cut(df: DataFrame) -> DataFrame:
    """`df`, written to the checkpoint folder; one in the warehouse is named where the cluster names none, and goes at exit."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/tessera-checkpoints")
        remove_at_exit(df.sparkSession, context.getCheckpointDir())
    return df.checkpoint()


def number_rows(rows: DataFrame, order: list, out: str = "place") -> DataFrame:
    """`out`: 1 for the first row of the order, and so on.

    Rows go to ranges of the order, each range counts its own, and the counts before it (one
    row a range) are added. Ranges are written, so that both passes see the same ones. The order
    must tell all rows apart for the result to be one.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(out, rank).join(offsets, "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


def rank_within(rows: DataFrame, keys: list[str], hashed: Column, ties: list, out: str, bits: int = 12) -> DataFrame:
    """`out`: place of a row among those of its keys in the order of a 64-bit hash, then `ties`, from 1.

    A key's rows are spread over 2**bits buckets of the hash; buckets before a row's own are counted.
    """
    marked = rows.withColumn("_h", hashed).withColumn("_b", F.shiftright("_h", 64 - bits))
    counts = marked.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_b").alias("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = marked.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *ties)))
    same = F.col("_b") == F.col("_bucket")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return ranked.join(earlier, same).withColumn(out, F.col(out) + F.col("_before")).drop("_h", "_b", "_bucket", "_before", *[f"_{i}" for i in range(len(keys))])


def turn_positions(rows: DataFrame, turn: str, order: list, out: str = "position", width: int = 4096) -> DataFrame:
    """`out`: place in the order by (turn, order), from 1, for turns numbered from 1.

    Rows of one turn are ranked together; the rows of all earlier turns come from counts by turn,
    added up within blocks of `width` turns and over the blocks.
    """
    counts = rows.groupBy(turn).agg(F.count("*").alias("_n")).withColumn("_block", F.floor((F.col(turn) - 1) / width))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_b"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_b").over(earlier(Window.orderBy("_block"))), F.lit(0)).alias("_before_block"))
    within = F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("_block").orderBy(turn))), F.lit(0))
    before = counts.withColumn("_within", within).join(blocks, "_block").select(turn, (F.col("_within") + F.col("_before_block")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(turn).orderBy(*order))
    return rows.withColumn(out, rank).join(before, turn).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def in_ranges(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """`rows` with `_range`: written in ranges of (keys, order), so a hot key has many ranges and at most one key of a range goes on into the next."""
    return cut(rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_range", F.spark_partition_id()))


def same_keys(keys: list[str], prefix: str = "_of_") -> Column:
    """Equality of `keys` with the columns of the same names behind a prefix; null equals null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def carried_in(ranged: DataFrame, keys: list[str], totals: dict[str, Column], carried: dict[str, Column]) -> DataFrame:
    """`ranged` with what each range carries in from the ranges of the same keys before it, null in the first of them.

    `totals` are aggregates by (keys, range); `carried` are window columns over them in the order of ranges, from
    the first to the one before. Only ranges in which a key goes on are joined, fewer than there are ranges, so they are sent.
    """
    by = Window.partitionBy(*keys).orderBy("_range")
    blocks = ranged.groupBy(*keys, "_range").agg(*[c.alias(n) for n, c in totals.items()])
    for name, column in carried.items():
        blocks = blocks.withColumn(name, column.over(by.rowsBetween(Window.unboundedPreceding, -1)))
    later = blocks.withColumn("_nth", F.row_number().over(by)).where("_nth > 1")
    later = later.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of__range"), *carried)
    joined = ranged.join(F.broadcast(later), same_keys([*keys, "_range"]), "left")
    return joined.drop("_of__range", *[f"_of_{k}" for k in keys])


def rank_in_ranges(rows: DataFrame, keys: list[str], order: list, out: str) -> DataFrame:
    """`out`: place of a row among those of its keys in the order, from 1, by ranges; the order must tell a key's rows apart."""
    ranged = in_ranges(rows, keys, order)
    ranged = ranged.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    counted = carried_in(ranged, keys, {"_count": F.count("*")}, {"_before": F.sum("_count")})
    return counted.withColumn(out, F.col(out) + F.coalesce("_before", F.lit(0))).drop("_range", "_before")
