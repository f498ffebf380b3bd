"""Audits: reconciliation, duplicate and leak checks, partitions, configuration."""

from __future__ import annotations

import hashlib

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(expected: DataFrame, found: DataFrame, key: str, compare: dict[str, str]) -> DataFrame:
    """key, problem: `missing`, or `<name> differs` for each column pair (expected, found) of `compare`."""
    right = found.select(F.col(key), F.lit(True).alias("_there"), *[F.col(c).alias(f"_f_{c}") for c in compare.values()])
    both = expected.join(right, key, "left")
    problems = [F.when(F.col("_there").isNull(), F.lit("missing"))]
    problems += [F.when(F.col("_there") & ~F.col(a).eqNullSafe(F.col(f"_f_{b}")), F.lit(f"{a} differs")) for a, b in compare.items()]
    return both.select(key, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def duplicate_groups(rows: DataFrame, digest: str, member: str) -> DataFrame:
    """digest, n, first_member of digests that occur more than once; members come by a join if they are needed."""
    return rows.groupBy(digest).agg(F.count("*").alias("n"), F.min(member).alias("first_member")).where("n > 1")


def cross_split_overlap(rows: DataFrame, split: str, keys: list[str]) -> DataFrame:
    """kind, n: for each key column, how many of its values occur in more than one split."""
    parts = []
    for key in keys:
        spread = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(split).alias("_s")).where("_s > 1")
        parts.append(spread.agg(F.count("*").alias("n")).select(F.lit(key).alias("kind"), "n"))
    return reduce(DataFrame.unionByName, parts)


def split_intersections(rows: DataFrame, split: str, key: str) -> DataFrame:
    """split_a, split_b, n: values that both splits hold, for every pair that shares any."""
    have = rows.select(split, key).distinct()
    other = have.select(F.col(split).alias("split_b"), key)
    return have.withColumnRenamed(split, "split_a").join(other, key).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("n"))


def partition_check(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """missing, extra, shared: keys of the whole in no part, of parts not in the whole, in more than one part."""
    tagged = reduce(DataFrame.unionByName, [p.select(key).distinct().withColumn("_part", F.lit(i)) for i, p in enumerate(parts)])
    held = tagged.groupBy(key).agg(F.count("*").alias("_parts"))
    both = whole.select(key).distinct().withColumn("_whole", F.lit(True)).join(held, key, "full")
    return both.agg(F.count_if(F.col("_parts").isNull()).alias("missing"), F.count_if(F.col("_whole").isNull()).alias("extra"), F.count_if(F.coalesce(F.col("_parts"), F.lit(0)) > 1).alias("shared"))


def config_differences(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """key, expected, observed of keys that differ or that only one side has (tables of key and value)."""
    both = expected.select("key", F.col("value").alias("expected")).join(observed.select("key", F.col("value").alias("observed")), "key", "full")
    return both.where(~F.col("expected").eqNullSafe(F.col("observed")))


def named_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """name, passed of each aggregate check."""
    row = df.agg(*[c.alias(k) for k, c in checks.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(F.col(k), F.lit(False)).alias("passed")) for k in checks])
    return row.select(F.explode(pairs).alias("c")).select("c.name", "c.passed")


def audit(checks: DataFrame) -> DataFrame:
    """passed (all of them), and the names of those that failed, joined by `;`."""
    return checks.agg(F.bool_and("passed").alias("passed"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("name")))), ";").alias("failed"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the left without a partner: an inner lookup that must be complete expects none."""
    return left.join(right, keys, "left_anti")


def complete_lookup(left: DataFrame, right: DataFrame, keys: list[str], *, right_order: list) -> DataFrame:
    """Left rows with their partner's columns and `_missing`; of right rows with one key the last counts."""
    from .curation import keep_first

    last = keep_first(right, keys, [F.desc(c) if isinstance(c, str) else c for c in right_order]).withColumn("_there", F.lit(True))
    return left.join(last, keys, "left").withColumn("_missing", F.col("_there").isNull()).drop("_there")


def table_digest(rows: DataFrame, columns: list[str] | None = None) -> str:
    """One digest of a whole table: the same for any partitioning and order of rows, changed by any cell, row, repetition, name or type.

    Rows become canonical JSON and its digest; digests are counted, put together by their leading digits, in groups of
    about a thousand, and the groups' digests again until one is left. Where the order is part of what
    a table says, a column must hold it. The driver gets the row count and the digest.
    """
    names = sorted(columns or rows.columns)
    row = F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)
    level = rows.select(row.alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    level = level.select("h", F.concat_ws(":", "h", "n").alias("leaf"))
    digits, count = 0, level.count()
    while count > 2048 * 16**digits:
        digits += 1
    while True:
        level = level.groupBy(F.substring("h", 1, digits).alias("h")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("leaf")), ""), 256).alias("leaf"))
        if digits == 0:
            break
        digits = max(0, digits - 2)
    top = level.first()
    kinds = ",".join(f"{n}:{rows.schema[n].dataType.simpleString()}" for n in names)
    return hashlib.sha256(f"{kinds}\n{top['leaf'] if top else ''}".encode()).hexdigest()
