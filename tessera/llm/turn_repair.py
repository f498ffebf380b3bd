"""Operator 13: damaged conversations are audited by signature and repaired by replay.

What a repair costs depends on roles and faults alone, one letter a row. Rows become letters by
built-in functions, letters one string a conversation, and each distinct string is solved once, by
a recursion that halves it and remembers its halves. The audit joins back by the string, and a
stream over sorted rows replays its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, CRC_TABLE_SQL, Scratch, crc_sql, documents, with_estimates

#: Fixed values of the contract: costs of edits, and how roles may follow each other.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE_OF = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
ROLE_OF = {"u": "user", "a": "assistant"}


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: each row after its damage, and how often it then stands there (0: dropped)."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    shown = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(shown.cast("binary")) % 20
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))


def letter_rows(scratch: Scratch, damaged: DataFrame) -> DataFrame:
    """key, conv_id, turn, role, text, copies, letters, initials, range and counts of faults: alike rows as one, in ranges of their order.

    `letters` has one for each copy: s, u, a or x by the role's initial, capital where truncated, and d where
    the row must go. Only the first of what a conversation says again is not a duplicate, so which one that is comes from
    a minimum by (conversation, role, text), not from a window over a conversation.
    """
    rows = damaged.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumns({"key": _key(), "print": F.sha2(F.concat_ws("\n", "role", "text"), 256)})
    rows = scratch.cut(rows.repartitionByRange("key", F.col("turn").asc_nulls_first(), "role", "text").withColumn("range", F.spark_partition_id()))
    due = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = rows.where("copies > 0").groupBy("key", "print").agg(F.min(due).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = scratch.cut(said)
    rows = with_estimates(rows.withColumn("due", due), again, ["key", "print"], again.count())
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    cut = ~F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    later = F.coalesce(F.col("due") > F.col("first"), F.lit(False))
    rest = F.greatest(F.col("copies") - 1, F.lit(0))
    there = F.col("copies") > 0
    times = lambda letter, n: F.repeat(letter, n.cast("int"))
    return rows.select(
        "key", "conv_id", "turn", "role", "text", "copies", "range",
        F.when(~there, "").when(blank | later, times(F.lit("d"), F.col("copies"))).otherwise(F.concat(F.when(cut, F.upper(kind)).otherwise(kind), times(F.lit("d"), rest))).alias("letters"),
        times(kind, F.col("copies")).alias("initials"),
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"),
        F.when(blank | ~there, 0).when(later, F.col("copies")).otherwise(rest).alias("duplicate"),
        F.when(there & ~blank & ~later & cut, 1).otherwise(0).alias("truncated"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """One row a conversation: key, conv_id, signature, gaps, blank, duplicate, truncated, illegal.

    Strings are put together within ranges, then across them, so a conversation with most of the rows is
    shared out, and what meets in the end is one byte a row.
    """
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text")
    pieces = rows.groupBy("key", "conv_id", "range").agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), "letters", "initials"))).alias("list"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    pieces = pieces.withColumns({c: F.array_join(F.col(f"list.{c}"), "") for c in ("letters", "initials")}).drop("list")
    whole = pieces.groupBy("key", "conv_id").agg(F.sort_array(F.collect_list(F.struct("range", "letters", "initials"))).alias("list"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    legal, initials = F.regexp_count("initials", F.lit("(?=su|ua|au)")), F.array_join(F.col("list.initials"), "")
    whole = whole.select("key", "conv_id", F.array_join(F.col("list.letters"), "").alias("signature"), initials.alias("initials"), "blank", "duplicate", "truncated")
    whole = whole.withColumn("illegal", (F.greatest(F.length("initials") - 1, F.lit(0)) - legal).cast("long")).drop("initials")
    numbers = rows.where("copies > 0 and turn is not null").groupBy("key", "turn").agg(F.lit(1).alias("one"))
    gaps = numbers.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.sum("one")).alias("gaps"))
    return whole.join(gaps, "key", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)).cast("long"))


Best = dict[tuple[int, int], tuple[int, str]]


def one_letter(letter: str) -> Best:
    """From state to state over one row, after up to two insertions, the least cost and the ASCII-least edits of that cost."""
    best: Best = {}
    extra, role = (TRUNCATED if letter.isupper() else 0), letter.lower()
    for start in FOLLOWS:
        state, cost, edits = start, 0, ""
        for _ in range(3):
            ways = [(state, DELETE, "D")]
            if role != "d":
                ways += [(STATE_OF[r], KEEP + extra, "K") for r in FOLLOWS[state] if r == role]
                ways += [(STATE_OF[r], REROLE + extra, "R") for r in FOLLOWS[state] if r in ROLE_OF]
            for end, more, edit in ways:
                best[start, end] = min(best.get((start, end), (cost + more, edits + edit)), (cost + more, edits + edit))
            state, cost, edits = STATE_OF[FOLLOWS[state][-1]], cost + INSERT, edits + "I"
    return best


class Solver:
    """Cheapest repairs of signatures; halves of signatures are remembered between them.

    Of edits between the same states that cost the same none begins another (the longer one would have
    insertions to pay for besides), so the least of a whole is made of the least of its halves.
    """

    def __init__(self, remembered: int = 20_000):
        self.known: dict[str, Best] = {}
        self.remembered = remembered

    def between(self, letters: str) -> Best:
        if (found := self.known.get(letters)) is not None:
            return found
        if len(letters) == 1:
            best = one_letter(letters)
        else:
            half = 1 << (len(letters) - 1).bit_length() - 1
            left, right, best = self.between(letters[:half]), self.between(letters[half:]), {}
            for (start, middle), (cost, edits) in left.items():
                for end in FOLLOWS:
                    if (more := right.get((middle, end))) is not None:
                        way = (cost + more[0], edits + more[1])
                        best[start, end] = min(best.get((start, end), way), way)
        if len(letters) <= 32 and len(self.known) < self.remembered:
            self.known[letters] = best
        return best

    def solve(self, signature: str) -> tuple[int, str]:
        best = self.between(signature) if signature else {(START, START): (0, "")}
        ends = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        return min((cost + INSERT * len(ends[end]), edits + ends[end]) for (start, end), (cost, edits) in best.items() if start == START)


def solve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    solver = Solver()
    for batch in batches:
        solved = [solver.solve(s) for s in batch["signature"]]
        yield pd.DataFrame({"signature": batch["signature"], "cost": [c for c, _ in solved], "audit": [a for _, a in solved]})


class Replay:
    """The repaired turns of one conversation, taken up by a digest as its rows come by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.digest, self.begun = audit, 0, START, hashlib.sha256(), False

    def _say(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def _next_role(self) -> str:
        letter = FOLLOWS[self.state][-1]
        self.state = STATE_OF[letter]
        return ROLE_OF[letter]

    def _insert(self) -> None:
        while self.audit.startswith("I", self.at):
            self._say(self._next_role(), "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = STATE_OF[role[0]]
            self._say(role, text)
        elif edit == "R":
            self._say(self._next_role(), text)

    def end(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def replay_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, each headed by its audit (head 0), to key and repaired_sha256; holds one batch and one audit."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])
    key, replay = None, None
    for batch in batches:
        done = []
        for k, head, role, text, copies in zip(*[batch.column(c).to_pylist() for c in ("key", "head", "role", "text", "copies")]):
            if head == 0:
                if replay:
                    done.append((key, replay.end()))
                key, replay = k, Replay(text)
            else:
                for _ in range(copies):
                    replay.row(role, text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done)], schema=schema)
    if replay:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([replay.end()], pa.string())], schema=schema)


def repair_conversations(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """Per conversation of `turns` its faults after damage, the cheapest edits and the digest of what they make of it.

    A null in conv_id, turn, role or text reads as one space; rows without a conv_id are one conversation.
    Null turns come first; rows of one turn follow by role, then text, and alike rows are adjacent. A role
    counts by its first character, and one that is not s, u or a can only be changed or deleted. Conversations of
    which nothing is left have zeros, an empty audit and the digest of nothing; an empty table
    gives an empty result. Other columns are ignored.

    Faults and signatures are made without a task that holds a conversation; what meets is one byte a
    row, as in the audit itself. A digest can only be taken in order, so the replay streams each conversation through one
    task, which sorts on disk and holds a batch.
    """
    scratch = Scratch(spark)
    rows = scratch.cut(letter_rows(scratch, damage(turns)))
    known = scratch.cut(signatures(rows))
    solved = scratch.cut(known.select("signature").distinct().mapInPandas(solve_batches, "signature string, cost long, audit string"))
    audited = scratch.cut(with_estimates(known, solved, ["signature"], solved.count(), how="inner").drop("signature"))
    heads = audited.select("key", F.lit(0).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"))
    stream = rows.where("copies > 0").select("key", F.lit(1).alias("head"), "turn", "role", "text", "copies").unionByName(heads)
    ordered = stream.repartition("key").sortWithinPartitions("key", "head", F.col("turn").asc_nulls_first(), "role", "text")
    digests = ordered.mapInArrow(replay_batches, "key string, repaired_sha256 string")
    return audited.join(digests, "key").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(spark, documents(spark, sf_dir, "conversations"))


_WORD_SQL = f"[^{BLANKS}]"
OP13_SQL = rf"""
WITH RECURSIVE {CRC_TABLE_SQL},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind, row_number() OVER () AS id FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, id, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
            unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM given),
ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, id, copy) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id, copy) > 1 AS again,
           NOT regexp_matches(text, '{_WORD_SQL}') AS blank, NOT regexp_matches(text, '[.!?][{BLANKS}]*\z') AS cut, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS initial FROM damaged),
lettered AS (SELECT *, CASE WHEN blank OR again THEN 'd' WHEN cut THEN upper(initial) ELSE initial END AS letter, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ranked),
facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
          count(*) FILTER (cut AND letter <> 'd') AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, string_agg(letter, '' ORDER BY n) AS signature FROM lettered GROUP BY conv_id),
follows(state, role, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(state, next, edits) AS (
  SELECT state, state, '' FROM (SELECT DISTINCT state FROM follows)
  UNION ALL SELECT i.state, f.next, i.edits || 'I' FROM inserts i JOIN follows f ON f.state = i.next AND f.role <> 's' WHERE length(i.edits) < 2),
moves(letter, state, next, edit, cost) AS (
  SELECT l, state, next, 'K', CASE WHEN l = upper(l) THEN 3 ELSE 0 END FROM follows, unnest(['s', 'u', 'a', 'S', 'U', 'A']) v(l) WHERE lower(l) = role
  UNION ALL SELECT l, state, next, 'R', CASE WHEN l = upper(l) THEN 6 ELSE 3 END FROM follows, unnest(['s', 'u', 'a', 'x', 'S', 'U', 'A', 'X']) v(l) WHERE role <> 's'
  UNION ALL SELECT l, state, state, 'D', 4 FROM (SELECT DISTINCT state FROM follows), unnest(['s', 'u', 'a', 'x', 'S', 'U', 'A', 'X', 'd']) v(l)),
paths(signature, i, state, best) AS (
  SELECT signature, 0, 0, {{'cost': 0, 'audit': ''}} FROM (SELECT DISTINCT signature FROM facts WHERE signature IS NOT NULL)
  UNION ALL
  SELECT p.signature, p.i + 1, m.next, min({{'cost': (p.best.cost + 3 * length(e.edits) + m.cost)::INTEGER, 'audit': p.best.audit || e.edits || m.edit}})
  FROM paths p JOIN inserts e ON e.state = p.state JOIN moves m ON m.state = e.next AND m.letter = p.signature[p.i + 1] GROUP BY p.signature, p.i + 1, m.next),
solved AS (SELECT signature, min({{'cost': best.cost + 3 * length(last), 'audit': best.audit || last}}) AS best FROM (SELECT *, CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS last FROM paths WHERE i = length(signature)) GROUP BY signature),
edits AS (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS j FROM facts JOIN solved USING (signature)),
placed AS (SELECT conv_id, audit[j] AS edit, count(*) FILTER (audit[j] <> 'I') OVER w AS n, count(*) FILTER (audit[j] <> 'D') OVER w AS o FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
shown AS (SELECT p.conv_id, p.edit, p.o, r.role, r.text, bool_or(p.edit = 'K' AND p.o = 1 AND r.initial = 's') OVER (PARTITION BY p.conv_id) AS headed
          FROM placed p LEFT JOIN lettered r ON p.edit <> 'I' AND r.n = p.n AND r.conv_id IS NOT DISTINCT FROM p.conv_id WHERE p.edit <> 'D'),
repaired AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (o + headed::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY o) AS said FROM shown GROUP BY conv_id)
SELECT c.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
       coalesce(s.best.cost, 0)::BIGINT AS cost, coalesce(s.best.audit, '') AS audit, sha256(coalesce(r.said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN solved s ON s.signature = f.signature LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""
