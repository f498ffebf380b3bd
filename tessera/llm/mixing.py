"""Operator 1: mixing sources to target weights by a low-discrepancy schedule of blocks.

Every source's documents, in a shuffled order, lie on a line of tokens; the line is cut into
blocks of equal length. Slot k of the mix takes the point of the van der Corput sequence with
index k, maps it through the sources' cumulative targets, and so names a source; the slot's rank
among its source's slots names the block. Sources are therefore interleaved in proportion at
every prefix of the mix, and no state has to pass from slot to slot.

Only built-in functions are used. A hot source is split: its running totals are taken over
buckets of the shuffle hash, its slots' ranks over chunks of slots.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, bucket_bits, documents, number_rows, running_before, top_bits


class Mix(NamedTuple):
    """sources: one row a source; lines: one row a document with its place; pieces: the mix itself."""

    sources: DataFrame
    lines: DataFrame
    pieces: DataFrame


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(scratch: Scratch, sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """sid, source, weight, source_size, target: `share` of all sizes by weight, none above `most` times its size.

    The sources are numbered by code point, null last, and take the weights in turn. What a
    source cannot take is shared again by weight until no source is above its limit; a round
    is one aggregate over the table of sources, of which the driver sees two sums.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = number_rows(scratch, sources, [F.col("source").asc_nulls_last()], "sid")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    sources = scratch.cut(sources.withColumn("weight", turn))
    limit = F.col("source_size") * float(most)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, F.lit(False)
    held = -1
    while total:
        state = sources.agg(
            F.sum(F.when(full, limit).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)
        ).first()
        if state[2] == held or not state[1]:
            break
        held = state[2]
        rate = (share * total - state[0]) / state[1]
        full = F.col("weight") * rate >= limit
    return sources.withColumn("target", F.when(full, limit).otherwise(F.col("weight") * rate))


def schedule(spark: SparkSession, sources: DataFrame, n_slots: int, total: int, cells: int = 1024, chunk: int = 4096) -> DataFrame:
    """slot, sid, block: which block of which source fills each slot.

    `sources` has sid, low and high (its part of the line of `total` tokens) and blocks (how
    many it must fill). A point's source is found by an equality join on the cell of the line.
    Ranks beyond a source's last block are left out; blocks that the points have not reached,
    at most about log2(slots) of a source, close the schedule.
    """
    bits = max(1, n_slots.bit_length())
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("double")
    point = F.floor(reversed_bits / float(2**bits) * F.lit(float(total))).cast("long")
    width = max(1, -(-total // cells))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), F.least(point, F.lit(total - 1)).alias("at"))
    points = points.withColumn("cell", F.floor(F.col("at") / width))
    held = sources.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    mapped = points.join(held, "cell").where("at >= low and at < high").select("slot", "sid", "blocks", F.floor(F.col("slot") / chunk).alias("chunk"), F.lit(1).alias("one"))
    ranked = running_before(mapped, ["sid"], "chunk", ["slot"], {"block": "one"})
    kept = ranked.where("block < blocks").select("slot", "sid", "block")
    reached = ranked.groupBy("sid").agg(F.count("*").alias("reached"))
    missing = sources.join(reached, "sid", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached < blocks")
    closing = missing.select("sid", "reached", F.explode(F.sequence(F.col("reached"), F.col("blocks") - 1)).alias("block"))
    return kept.unionByName(closing.select((F.lit(n_slots) + F.col("block") - F.col("reached")).alias("slot"), "sid", "block"))


def mix_sources(spark: SparkSession, docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_tokens: int = 1024, seed: int = 20240501) -> Mix:
    """Mix all documents; needs doc_id, text and source, and ignores other columns.

    pieces: slot, source, block, doc_id, sid, line_start, start, length - words [start, start +
    length) of the document go to the slot; a document taken twice has pieces of both rounds.
    Null text counts as empty; a document without words and a source without words are never
    taken; null is a source of its own, numbered last; repeated rows are documents of their own,
    as are rows of one doc_id; an empty table gives empty results. The order depends on `seed`
    and the rows alone.
    """
    scratch = Scratch(spark)
    sized = scratch.cut(docs.select("doc_id", "source", word_count().alias("size")))
    bits = bucket_bits(sized.count())
    sources = scratch.cut(source_targets(scratch, sized, weights, share, most).withColumn("limit", F.least(F.round("target").cast("long"), F.floor(F.col("source_size") * float(most)))))
    sources = sources.withColumn("blocks", F.ceil(F.col("limit") / block_tokens)).withColumn("group", F.floor(F.col("sid") / 1024))
    sources = scratch.cut(running_before(sources, [], "group", ["sid"], {"low": "limit"}).withColumn("high", F.col("low") + F.col("limit")))
    n_slots, total = sources.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("limit"), F.lit(0))).first()

    mixed = F.xxhash64(F.lit(seed), "doc_id", "size")
    lines = sized.withColumn("h", mixed).withColumn("bucket", top_bits(F.col("h"), bits))
    known = sources.select("sid", F.col("source").alias("_source"), "source_size", "target", "limit")
    lines = lines.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    lines = scratch.cut(running_before(lines, ["sid"], "bucket", ["h", "doc_id", "size"], {"line_start": "size"}).drop("h", "bucket"))

    rounds = F.explode(F.sequence(F.lit(0), F.lit(max(0, int(-(-most // 1)) - 1)))).alias("round")
    parts = lines.where("size > 0").select("*", rounds).withColumn("low", F.col("line_start") + F.col("round") * F.col("source_size"))
    parts = parts.withColumn("high", F.least(F.col("low") + F.col("size"), F.col("limit"))).where("low < high")
    parts = parts.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block_tokens), F.floor((F.col("high") - 1) / block_tokens))))
    first = F.greatest(F.col("low"), F.col("block") * block_tokens)
    last = F.least(F.col("high"), (F.col("block") + 1) * block_tokens)
    parts = parts.select("sid", "block", "doc_id", "source", "line_start", (first - F.col("low")).alias("start"), (last - first).alias("length"))
    if not n_slots:
        return Mix(sources, lines, parts.withColumn("slot", F.lit(0).cast("long")))
    slots = schedule(spark, sources.select("sid", "low", "high", "blocks"), n_slots, total)
    return Mix(sources, lines, parts.join(slots, ["sid", "block"]))


def taken_words(mix: Mix) -> DataFrame:
    """Every document of the mix with the words that its pieces take."""
    taken = mix.pieces.groupBy("sid", "line_start").agg(F.sum("length").alias("taken"))
    worded, empty = mix.lines.where("size > 0"), mix.lines.where("size = 0")
    return worded.join(taken, ["sid", "line_start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0))).unionByName(empty.withColumn("taken", F.lit(0).cast("long")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(spark, documents(spark, sf_dir))
    return taken_words(mix).select("doc_id", "size", "source_size", "target", "taken", "source")
