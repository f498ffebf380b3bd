"""Operator 12: a Merkle manifest of a dataset, with proofs.

Leaves are hashed by built-in functions and placed by ranges; from then on only digests move.
A bucket is 3^7 consecutive nodes of one level, aligned to the tree, so no run crosses it: DuckDB
climbs its levels inside a task by ordered `string_agg` and `sha256`. The roots of buckets are the
nodes of a level further up, and go the same way until one is left for each source; then the
subroots do. On the way down the path above a bucket, a few digests, meets the leaves of the bucket, and DuckDB
folds both parts of every proof.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, Scratch, crc_sql, documents, number_rows, with_estimates

RUN, LEVELS = 3, 7
BUCKET = RUN**LEVELS

ROOTS = "key long, bucket long, digest string, depth int, levels int"
PATHS = "key long, pos long, below int, lefts array<string>, rights array<string>, top string"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon, and the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def hash_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, place (of the source, `-` or `=source`), leaf and tampered (the leaf of what a reader is given)."""
    head = F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")])
    leaf = F.sha2(F.concat(head, field(F.col("text"))), 256)
    broken = F.sha2(F.concat(head, field(F.replace("text", F.lit("\n"), F.lit("")))), 256)
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    place = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), leaf.alias("leaf"), F.when(even, broken).otherwise(leaf).alias("tampered"))


def depth_of(n: Column) -> Column:
    """Levels until n nodes are one."""
    return sum(((n > RUN**k).cast("int") for k in range(40)), F.lit(0)).cast("int")


def _climb_sql(levels: int, carried: dict[str, tuple[str, str]], keep: list[str], ending: str) -> str:
    """SQL over `nodes` (key, pos, digest, ...): runs and nodes of each level in turn, and for each node what it carries up.

    `carried` maps a column to its start and its step, in which s is the node's row and a and b are the siblings before and after it.
    """
    rows = ", ".join(["key", *keep, *[f"{start} AS {c}" for c, (start, _) in carried.items()]])
    parts = ["l0 AS MATERIALIZED (SELECT key, pos, digest FROM nodes)", f"s0 AS (SELECT pos AS node, {rows} FROM nodes)"]
    for k in range(1, levels + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT key, pos // {RUN} AS pos, string_agg(digest, '' ORDER BY pos) AS run FROM l{k - 1} GROUP BY key, pos // {RUN})")
        parts.append(f"l{k} AS MATERIALIZED (SELECT key, pos, sha256(run) AS digest FROM r{k})")
        if carried:
            steps = ", ".join(["key", *keep, *[f"{step} AS {c}" for c, (_, step) in carried.items()]])
            sides = f"SELECT x.*, r.run[:64 * (x.node % {RUN})] AS a, r.run[64 * (x.node % {RUN}) + 65:] AS b FROM s{k - 1} x JOIN r{k} r ON r.key = x.key AND r.pos = x.node // {RUN}"
            parts.append(f"s{k} AS (SELECT node // {RUN} AS node, {steps} FROM ({sides}) s)")
    return f"WITH {', '.join(parts)} {ending}"


def _run(sql: str, **tables: pa.Table) -> pa.Table:
    with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
        for name, table in tables.items():
            con.register(name, table)
        return con.sql(sql).to_arrow_table()


def _as(table: pa.Table, **types: pa.DataType) -> pa.Table:
    return table.select(list(types)).cast(pa.schema(list(types.items())))


def block_roots(nodes: pa.Table) -> pa.Table:
    levels = nodes["levels"][0].as_py()
    ending = f"SELECT n.key, n.bucket, l.digest, n.depth - {levels} AS depth, {levels} AS levels FROM (SELECT DISTINCT key, bucket, depth FROM nodes) n JOIN l{levels} l USING (key)"
    return _as(_run(_climb_sql(levels, {}, [], ending), nodes=nodes), key=pa.int64(), bucket=pa.int64(), digest=pa.string(), depth=pa.int32(), levels=pa.int32())


def block_paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The siblings of each node up to the top: those within the bucket, then those above it."""
    levels = nodes["levels"][0].as_py()
    carried = {"lefts": ("[]::VARCHAR[]", "list_append(s.lefts, s.a)"), "rights": ("[]::VARCHAR[]", "list_append(s.rights, s.b)")}
    ending = f"SELECT s.key, s.pos, s.below, s.lefts || o.lefts AS lefts, s.rights || o.rights AS rights, o.top FROM s{levels} s JOIN above o USING (key)"
    out = _run(_climb_sql(levels, carried, ["pos", "below"], ending), nodes=nodes, above=above)
    return _as(out, key=pa.int64(), pos=pa.int64(), below=pa.int32(), lefts=pa.list_(pa.string()), rights=pa.list_(pa.string()), top=pa.string())


def block_proofs(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf: through the levels of the bucket, then along the path above it, which is as long for all of a block."""
    levels = nodes["levels"][0].as_py()
    carried = {"proof": ("''", "s.proof || s.a || s.b"), "folded": ("tampered", "sha256(s.a || s.folded || s.b)")}
    folded, proof = "s.folded", "s.proof"
    for k in range(1, len(above["lefts"][0]) + 1):
        folded, proof = f"sha256(o.lefts[{k}] || {folded} || o.rights[{k}])", f"{proof} || o.lefts[{k}] || o.rights[{k}]"
    leaves = f"SELECT s.doc_id, s.digest AS leaf, o.subroot, o.root, sha256({proof}) AS proof_sha256, {folded} AS folded_root FROM s{levels} s JOIN above o USING (key)"
    text = dict.fromkeys(("leaf", "subroot", "root", "proof_sha256", "folded_root"), pa.string())
    out = _run(_climb_sql(levels, carried, ["doc_id", "digest"], f"SELECT *, folded_root = root AS verified FROM ({leaves})"), nodes=nodes, above=above)
    return _as(out, doc_id=pa.int64(), **text, verified=pa.bool_())


def _blocks(nodes: DataFrame):
    """`nodes` (key, bucket, levels, ...) in blocks of one full bucket, or of the small trees of neighbouring keys, up to as many nodes."""
    alike = F.floor(F.col("key") / F.pow(F.lit(RUN), F.lit(LEVELS) - F.col("levels"))).cast("long")
    return nodes.withColumn("alike", alike).groupBy("levels", "alike", "bucket")


def _bucketed(nodes: DataFrame):
    return _blocks(nodes.withColumns({"bucket": F.floor(F.col("pos") / BUCKET), "levels": F.least("depth", F.lit(LEVELS))}))


def tree_tops(scratch: Scratch, nodes: DataFrame, depth: int) -> DataFrame:
    """key, bucket, levels, lefts, rights, top: for each bucket of `nodes` (key, pos, digest, depth) its levels, the path above it and the key's root."""
    roots = scratch.cut(_bucketed(nodes.select("key", "pos", "digest", "depth")).applyInArrow(block_roots, ROOTS))
    if depth <= LEVELS:
        none = F.array().cast("array<string>")
        return roots.select("key", "bucket", "levels", none.alias("lefts"), none.alias("rights"), F.col("digest").alias("top"))
    further = roots.select("key", F.col("bucket").alias("pos"), "digest", "depth", F.col("levels").alias("below"))
    return tree_paths(scratch, further, depth - LEVELS).withColumnsRenamed({"pos": "bucket", "below": "levels"})


def tree_paths(scratch: Scratch, nodes: DataFrame, depth: int) -> DataFrame:
    """key, pos, below, lefts, rights, top: for each of `nodes` (key, pos, digest, depth, below) its siblings, level by level, and the key's root."""
    above = tree_tops(scratch, nodes, depth)
    return scratch.cut(_bucketed(nodes).cogroup(_blocks(above)).applyInArrow(block_paths, PATHS))


def merkle_manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of `docs`: its leaf, its source's subroot, the root, the digest of its proof, and what folding the tampered leaf gives.

    Leaves of a source ascend by doc_id (null first; equal ones by leaf, so repeated rows are leaves of their
    own in a defined order), sources by bytes (null first). Null and empty fields differ, as `-` and
    `0:`. A lone leaf is its source's subroot, a lone subroot the root; its proof is the digest of nothing. An empty
    table gives an empty result. Columns other than doc_id, source, lang, n_chars and text are ignored.

    A source with most of the rows is spread over ranges and buckets like any other. The driver
    gets two numbers: the count of sources and the largest of their sizes.
    """
    scratch = Scratch(spark)
    order = [F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("tampered")]
    placed = scratch.cut(number_rows(scratch, hash_leaves(docs), order))
    sizes = placed.groupBy("place").agg(F.count("*").alias("n"), F.min("row_index").alias("first"))
    sources = scratch.cut(number_rows(scratch, sizes, [F.col("place")], "key").withColumn("depth", depth_of(F.col("n"))))
    count, largest = sources.agg(F.count("*"), F.max("n")).first()
    if not count:
        return spark.createDataFrame([], PROOFS)
    levels = lambda n: next(k for k in range(64) if n <= RUN**k)
    joined = with_estimates(placed, sources.select("place", "key", "first", "depth"), ["place"], count, how="inner")
    leaves = joined.select("key", (F.col("row_index") - F.col("first")).alias("pos"), "depth", "doc_id", F.col("leaf").alias("digest"), "tampered")
    tops = tree_tops(scratch, leaves, levels(largest))
    subroots = tops.where("bucket = 0").select(F.lit(0).cast("long").alias("key"), F.col("key").alias("pos"), F.col("top").alias("digest"), F.lit(levels(count)).alias("depth"), F.lit(0).alias("below"))
    outer = tree_paths(scratch, subroots, levels(count)).select(F.col("pos").alias("key"), F.col("lefts").alias("l"), F.col("rights").alias("r"), F.col("top").alias("root"))
    above = tops.join(outer, "key").select("key", "bucket", F.concat("lefts", "l").alias("lefts"), F.concat("rights", "r").alias("rights"), "levels", F.col("top").alias("subroot"), "root")
    return _bucketed(leaves).cogroup(_blocks(above)).applyInArrow(block_proofs, PROOFS)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(spark, documents(spark, sf_dir))


def _field_sql(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


_HEAD = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS place, sha256({_HEAD} || {_field_sql("text")}) AS leaf,
           CASE WHEN {crc_sql("doc_id::VARCHAR")} % 2 = 0 THEN sha256({_HEAD} || {_field_sql("replace(text, chr(10), '')")}) ELSE sha256({_HEAD} || {_field_sql("text")}) END AS tampered
           FROM documents, crc_table),
based AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY doc_id NULLS FIRST, leaf, tampered) - 1 AS pos, row_number() OVER () AS id FROM leaves),
nodes(place, level, pos, digest) AS (
  SELECT place, 0, pos, leaf FROM based
  UNION ALL
  SELECT place, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY place) AS n FROM nodes) WHERE n > 1 GROUP BY place, level + 1, pos // 3),
subroots AS (SELECT place, arg_max(digest, level) AS digest, max(level) AS depth, row_number() OVER (ORDER BY encode(place)) - 1 AS pos FROM nodes GROUP BY place),
tops(level, pos, digest) AS (
  SELECT 0, pos, digest FROM subroots
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level + 1, pos // 3),
runs AS (
  SELECT n.place, n.level, n.pos // 3 AS run, string_agg(n.digest, '' ORDER BY n.pos) AS whole FROM nodes n JOIN subroots s USING (place) WHERE n.level < s.depth GROUP BY n.place, n.level, n.pos // 3
  UNION ALL
  SELECT s.place, s.depth + t.level, t.pos // 3, string_agg(t.digest, '' ORDER BY t.pos) FROM tops t, (SELECT DISTINCT place, depth FROM subroots) s
  WHERE t.level < (SELECT max(level) FROM tops) GROUP BY s.place, s.depth + t.level, t.pos // 3),
walk(id, place, level, pos, proof, folded) AS (
  SELECT b.id, b.place, 0, CASE WHEN s.depth = 0 THEN s.pos ELSE b.pos END, '', b.tampered FROM based b JOIN subroots s USING (place)
  UNION ALL
  SELECT w.id, w.place, w.level + 1, CASE WHEN w.level + 1 = s.depth THEN s.pos ELSE w.pos // 3 END,
         w.proof || r.whole[:64 * (w.pos % 3)] || r.whole[64 * (w.pos % 3) + 65:], sha256(r.whole[:64 * (w.pos % 3)] || w.folded || r.whole[64 * (w.pos % 3) + 65:])
  FROM walk w JOIN subroots s USING (place) JOIN runs r ON r.place = w.place AND r.level = w.level AND r.run = w.pos // 3),
folded AS (SELECT id, sha256(arg_max(proof, level)) AS proof_sha256, arg_max(folded, level) AS folded_root FROM walk GROUP BY id),
root AS (SELECT arg_max(digest, level) AS root FROM tops)
SELECT b.doc_id, b.leaf, s.digest AS subroot, root.root, f.proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM based b JOIN subroots s USING (place) JOIN folded f USING (id), root
"""
