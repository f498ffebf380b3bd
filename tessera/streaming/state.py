"""Keyed state and streams: leases, reservations, memories, snapshots of telemetry.

A stream's batches go through `foreachBatch` to functions that also work on tables, so a stream
gives what one batch of all its rows would give.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.checks import table_digest
from ..operators.curation import keep_first
from ..operators.telemetry import lease_reusable
from ..sources.sinks import _exists, publish_version, read_version, versions


class ReservationConflict(ValueError):
    """A fact is held by another key or cell; the whole batch is refused."""


def upsert(state: DataFrame, changes: DataFrame, keys: list[str], order: list) -> DataFrame:
    """State in which the last change of each key replaces its row."""
    last = keep_first(changes, keys, order)
    return state.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*state.columns))


def claim_leases(state: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """Each wanted lease with `reused`: the held row if it is reusable, else the wanted one (lease_id, state, created_at, expires_at, uri)."""
    held = state.select("lease_id", F.struct("state", "created_at", "expires_at", "uri").alias("h"))
    both = wanted.select("lease_id", F.struct("state", "created_at", "expires_at", "uri").alias("w")).join(held, "lease_id", "left")
    reused = F.coalesce(lease_reusable(F.col("h.state"), F.col("h.created_at"), F.col("h.expires_at"), now), F.lit(False))
    return both.select("lease_id", F.when(reused, F.col("h")).otherwise(F.col("w")).alias("r"), reused.alias("reused")).select("lease_id", "r.*", "reused")


def reserve_many(state: DataFrame, wanted: DataFrame) -> DataFrame:
    """New reservations of (fact_id, key, cell): those held alike are left out; one that differs refuses all."""
    asked = wanted.select("fact_id", "key", "cell").distinct()
    both = asked.join(state.select("fact_id", F.col("key").alias("_k"), F.col("cell").alias("_c")), "fact_id", "left")
    clash = both.where("_k is not null and not (key <=> _k and cell <=> _c)").select("fact_id")
    twice = asked.groupBy("fact_id").count().where("count > 1").select("fact_id")
    if not clash.unionByName(twice).isEmpty():
        raise ReservationConflict("a fact is reserved otherwise")
    return both.where("_k is null").select("fact_id", "key", "cell")


def pending_after_resume(selection: DataFrame, results: DataFrame, key: str, selection_hash: str | None = None) -> DataFrame:
    """Rows of a selection without a finished result under the same selection, which is known by its own digest unless told."""
    digest = table_digest(selection) if selection_hash is None else selection_hash
    finished = results.where((F.col("selection_hash") == digest) & F.col("state").isin("complete", "completed", "rejected"))
    return selection.join(finished.select(key), key, "left_anti")


def repair_interrupted(status: DataFrame) -> DataFrame:
    """Running rows become pending again and give back the attempt that was interrupted."""
    running = F.col("state") == "running"
    return status.withColumn("attempts", F.when(running, F.greatest(F.lit(0), F.col("attempts") - 1)).otherwise(F.col("attempts"))).withColumn("state", F.when(running, "pending").otherwise(F.col("state")))


def snapshot_stream(events: DataFrame, fold, path: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Fold each micro-batch into a snapshot: `fold(state, batch)` gives the next version of the table at `path`.

    A version has the number of its batch, whether or not it has rows, so a batch that is run again after a
    failure finds its version and changes nothing. Read it by `read_version`.
    """

    def step(batch: DataFrame, number: int) -> None:
        _take(batch, number, fold, path, schema)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _take(batch: DataFrame, number: int, fold, path: str, schema: str) -> None:
    spark: SparkSession = batch.sparkSession
    known = versions(spark, path)
    if not known or known[-1] < number:
        publish_version(fold(read_version(spark, path, schema), batch), path, number)


def count_fold(keys: list[str], sums: list[str]):
    """A fold that keeps counts and sums by key."""

    def fold(state: DataFrame, batch: DataFrame) -> DataFrame:
        fresh = batch.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
        return state.unionByName(fresh).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])

    return fold


def budget_stop(spent: float, done: int, *, stop_at: float, target: int) -> str | None:
    """Why a run should stop, or None."""
    return "budget" if spent >= stop_at else "target" if done >= target else None


class _Stopped(Exception):
    """Raised before a batch is taken, so that it stays to be taken."""


def guarded_snapshot(events: DataFrame, fold, path: str, checkpoint: str, schema: str, *, spent: Column, done: Column, stop_at: float, target: int) -> str | None:
    """Take what the stream has, batch by batch, until the snapshot has reached the budget or the target; gives the reason to stop, or None.

    `spent` and `done` are aggregates over the snapshot. `path`/latest has its versions,
    `path`/history one row a batch taken (batch, spent, done, reason): what held after it. Limits are
    checked before a batch is taken, and the query ends without committing it, so a later run with higher limits goes on with the same
    rows. A batch that is run again after a failure finds its version and its row and changes nothing.
    """
    latest, history, log = f"{path}/latest", f"{path}/history", "batch long, spent double, done long, reason string"
    spark, reasons = events.sparkSession, []

    def last_row():
        seen = spark.read.schema(log).json(history) if _exists(spark, history) else spark.createDataFrame([], log)
        return seen.agg(F.max(F.struct("batch", "spent", "done")).alias("r")).first()["r"]

    def reason_of(row) -> str | None:
        return budget_stop(row["spent"], row["done"], stop_at=stop_at, target=target) if row else None

    def step(batch: DataFrame, number: int) -> None:
        last, known = last_row(), versions(spark, latest)
        if last and last["batch"] >= number:
            return
        if (not known or known[-1] < number) and (why := reason_of(last)):
            reasons.append(why)
            raise _Stopped(why)
        _take(batch, number, fold, latest, schema)
        used, have = read_version(spark, latest, schema).agg(spent.cast("double"), done.cast("long")).first()
        row = (number, used or 0.0, have or 0, budget_stop(used or 0.0, have or 0, stop_at=stop_at, target=target))
        spark.createDataFrame([row], log).coalesce(1).write.mode("append").json(history)

    query = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not reasons:
            raise
    return reason_of(last_row())


def migrate_resume(selection: DataFrame, results: DataFrame, outputs: DataFrame, key: str, selection_hash: str | None = None) -> DataFrame:
    """The selection with state (completed or pending) and n_outputs carried over from an earlier run, which is only read.

    Refused if the earlier run's results are of another selection, if one that is complete is not
    in this selection, or if its outputs repeat an output_id; `results`: key, state,
    selection_hash; `outputs`: key, output_id. Unless told, the selection is known by its own digest.
    """
    selection_hash = table_digest(selection) if selection_hash is None else selection_hash
    checks = (
        ("results of another selection", results.where(~F.col("selection_hash").eqNullSafe(F.lit(selection_hash)))),
        ("completed rows outside the selection", results.where("state = 'completed'").join(selection, key, "left_anti")),
        ("repeated outputs", outputs.groupBy("output_id").count().where("count > 1")),
    )
    for problem, rows in checks:
        if not rows.isEmpty():
            raise ValueError(problem)
    done = results.where("state = 'completed'").select(key).distinct().withColumn("_done", F.lit(True))
    counted = outputs.groupBy(key).agg(F.count("*").alias("_n"))
    out = selection.join(done, key, "left").join(counted, key, "left")
    state = F.when(F.col("_done"), "completed").otherwise("pending")
    return out.withColumn("state", state).withColumn("n_outputs", F.coalesce("_n", F.lit(0))).drop("_done", "_n")


def lookup(state: DataFrame, **key: object) -> DataFrame:
    """The rows of a state table with a key; its filters reach the scan. A null finds null."""
    for name, value in key.items():
        state = state.where(F.col(name).eqNullSafe(F.lit(value)))
    return state


def windowed_counts(events: DataFrame, at: str, keys: list[str], *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event time window with a watermark; an addition for streams whose rows come late."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def append_memory(memory: DataFrame, categories: DataFrame) -> DataFrame:
    """Memory with one row more for each distinct category of each new record (record_id, at, categories)."""
    return memory.unionByName(categories.select("record_id", "at", F.explode(F.array_distinct("categories")).alias("category")))
