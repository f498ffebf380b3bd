"""Operator 9: cumulative-snapshot collapse and chat formatting.

A log that saves a conversation after every turn holds it many times, each a prefix of the next.
Every turn's rank and hash are added up along its conversation, so each prefix has a fingerprint
of four sums; a conversation whose last fingerprint is an inner one of another is a prefix
of it and goes, by an anti-join on distinct fingerprints. Of equal conversations the smallest id
stays. What remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, running_before

SUMS = ["s0", "s1", "s2", "s3"]
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def prefix_fingerprints(turns: DataFrame, block: int = 1024) -> DataFrame:
    """conv_id, n (turns so far) and the sums that stand for the first n turns, one row a turn.

    Turns are ranked in blocks of their numbers, so one endless conversation is shared out.
    """
    content = [F.col("turn"), F.col("role"), F.col("text")]
    rows = turns.select("conv_id", *content, F.coalesce(F.floor(F.col("turn") / block), F.lit(-(2**62))).alias("block"), F.lit(1).alias("one"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranked = running_before(rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))), ["key"], "block", order, {"before": "one"})
    shown = [F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in (F.col("role"), F.col("text"))]
    hashes = [F.xxhash64(F.lit(salt), "before", *shown) for salt in ("a", "b")]
    low, high = (lambda h: h.bitwiseAND(0x7FFFFFFF)), (lambda h: F.shiftright(h, 32).bitwiseAND(0x7FFFFFFF))
    parts = [f(h).alias(f"h{i}") for i, (f, h) in enumerate((f, h) for h in hashes for f in (low, high))]
    hashed = ranked.select("conv_id", "key", "block", "turn", "role", "text", F.col("before").alias("n"), *parts)
    before = {f"b{i}": f"h{i}" for i in range(len(SUMS))}
    out = running_before(hashed, ["key"], "block", ["n"], before).withColumns({s: F.col(f"b{i}") + F.col(f"h{i}") for i, s in enumerate(SUMS)})
    return out.select("conv_id", "turn", "role", "text", (F.col("n") + 1).alias("n"), *SUMS)


def collapse_snapshots(spark: SparkSession, turns: DataFrame, *, block: int = 1024) -> DataFrame:
    """The turns (conv_id, turn, role, text, n) of conversations that no other one contains or equals with a smaller id.

    Turns follow their number; null numbers come first, ties go by role, then text; gaps in the
    numbers do not matter. Null and empty roles and texts differ from each other. Rows without a
    conv_id belong to none and are left out. A repeated row is a turn of its own. An empty table
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(spark)
    marked = scratch.cut(prefix_fingerprints(turns.where("conv_id is not null"), block))
    prints = marked.select("conv_id", "n", *SUMS)
    length = prints.groupBy("conv_id").agg(F.max("n").alias("length"))
    sized = prints.join(length, "conv_id")
    whole = sized.where("n = length").groupBy("n", *SUMS).agg(F.min("conv_id").alias("conv_id"))
    inner = sized.where("n < length").select("n", *SUMS).distinct()
    kept = scratch.cut(whole.join(inner, ["n", *SUMS], "left_anti").select("conv_id"))
    return marked.join(kept, "conv_id").select("conv_id", "turn", "role", "text", "n")


def render_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, chat: the turns in order, each between marks; null roles and texts are empty.

    Marks inside a text are broken up by a space, so that no text can end or begin a turn.
    """
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1|>")
    turn = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), plain, F.lit(CLOSE))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", turn.alias("t")))).alias("turns"))
    return listed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.t"), "").alias("chat"))


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_chats(collapse_snapshots(spark, documents(spark, sf_dir, "conversations")))


OP9_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
                  role, text, coalesce('=' || role, '-') || chr(1) || coalesce('=' || text, '-') AS key
           FROM conversations WHERE conv_id IS NOT NULL),
     p AS (SELECT conv_id, n, string_agg(key, chr(2)) OVER (PARTITION BY conv_id ORDER BY n) AS prefix, count(*) OVER (PARTITION BY conv_id) AS length FROM t),
     w AS (SELECT min(conv_id) AS conv_id, prefix FROM p WHERE n = length GROUP BY prefix),
     k AS (SELECT conv_id FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < length))
SELECT conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '< |\1|>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY n) AS chat
FROM t JOIN k USING (conv_id) GROUP BY conv_id
"""
