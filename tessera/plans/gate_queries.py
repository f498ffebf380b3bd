"""Gates, JSON and files: queries of operators that the other modules do not hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, facts
from ..sources import readers, sinks
from ..streaming import state
from .catalog import query, table
from .telemetry_queries import PAIRS
from .more_queries import scratch

NAMES = [leaf[1] for leaf in facts.LEAVES]
LEAF_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
REPORT = "STRUCT<agent_role: STRING, accepted: BOOLEAN, answer_verdict: STRING, counterfactual_verdict: STRING, natural_answer_matches_source_fact: BOOLEAN, leaf_boundary_correct: BOOLEAN, counterfactual_targets_planned_leaf: BOOLEAN, single_target_slot: BOOLEAN, additional_error_count: INT, answer_evidence_interval: STRUCT<start_sec: DOUBLE, end_sec: DOUBLE>, evidence_summary: STRING, shares_observations: BOOLEAN>"
PRE = "Comprehensive reliability validation"


@query(
    "p11_monitor_gate",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
          CASE WHEN l_linenumber = 1 THEN CASE WHEN l_returnflag = 'N' THEN NULL ELSE '{PRE} is missing' END
               WHEN l_linenumber = 2 THEN 'Exactly one monitor report is required'
               WHEN l_quantity < 3 THEN 'Monitor agent role is invalid'
               WHEN l_returnflag = 'R' THEN '{PRE} rejected: accepted'
               WHEN l_linestatus = 'F' THEN '{PRE} rejected: answer verdict'
               WHEN l_discount = 0.05 THEN '{PRE} rejected: counterfactual verdict'
               WHEN l_tax = 0.03 THEN '{PRE} rejected: natural answer grounding'
               WHEN l_partkey % 7 = 0 THEN '{PRE} rejected: leaf boundary'
               WHEN l_partkey % 7 = 1 THEN '{PRE} rejected: planned leaf target'
               WHEN l_partkey % 7 = 2 THEN '{PRE} rejected: single target slot'
               WHEN l_suppkey % 5 = 0 THEN '{PRE} rejected: additional error count'
               WHEN l_quantity > 30 THEN '{PRE} rejected: evidence interval overlap'
               WHEN l_suppkey % 5 = 1 THEN '{PRE} rejected: evidence summary'
               WHEN l_suppkey % 5 = 2 THEN '{PRE} rejected: independent observations' END AS reason
        FROM lineitem""",
)
def p11_gate(spark, sf):
    report = F.expr(f"""CAST(named_struct('agent_role', CASE WHEN l_quantity < 3 THEN 'other' ELSE 'monitor' END, 'accepted', l_returnflag <> 'R', 'answer_verdict', CASE WHEN l_linestatus = 'F' THEN 'unclear' ELSE 'supported' END,
        'counterfactual_verdict', CASE WHEN l_discount = 0.05 THEN 'supported' ELSE 'contradicted' END, 'natural_answer_matches_source_fact', l_tax <> 0.03, 'leaf_boundary_correct', l_partkey % 7 <> 0, 'counterfactual_targets_planned_leaf', l_partkey % 7 <> 1,
        'single_target_slot', l_partkey % 7 <> 2, 'additional_error_count', CASE WHEN l_suppkey % 5 = 0 THEN 1 END, 'answer_evidence_interval', named_struct('start_sec', l_quantity, 'end_sec', l_quantity + 5),
        'evidence_summary', CASE WHEN l_suppkey % 5 = 1 THEN ' ' ELSE 'seen' END, 'shares_observations', l_suppkey % 5 = 2) AS {REPORT})""")  # fmt: skip
    reports = F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, F.array(report, report)).otherwise(F.array(report))
    scope = F.struct(F.lit(0.0).alias("start_sec"), F.lit(30.0).alias("end_sec"))
    reason = facts.monitor_gate(reports, F.col("l_returnflag") == "N", scope, "monitor")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reason.alias("reason"))


@query(
    "n10_backparse",
    """SELECT p_partkey, list_filter(['brand', 'name', 'size'], lambda k: CASE k WHEN 'brand' THEN p_size % 3 = 0 WHEN 'name' THEN p_size % 2 = 0 ELSE p_size > 40 END) AS mismatches FROM part""",
)
def n10(spark, sf):
    c = F.col
    held = F.create_map(F.lit("brand"), c("p_brand"), F.lit("size"), c("p_size").cast("string"))
    parsed = F.create_map(F.lit("brand"), F.when(c("p_size") % 3 == 0, "?").otherwise(c("p_brand")), F.lit("size"), F.when(c("p_size") <= 40, c("p_size").cast("string")))
    parsed = F.when(c("p_size") % 2 == 0, F.map_concat(parsed, F.create_map(F.lit("name"), c("p_name")))).otherwise(parsed)
    return table(spark, sf, "part").select("p_partkey", facts.backparse_mismatches(parsed, held).alias("mismatches"))


@query(
    "n5_mutation_operators",
    f"""WITH l AS (SELECT unnest({LEAF_LIST}) AS leaf, unnest([{", ".join(f"'{x[4]}'" for x in facts.LEAVES)}]) AS o, unnest([{", ".join(f"'{x[3]}'" for x in facts.LEAVES)}]) AS s),
             m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 2 THEN 'Unknown' ELSE {LEAF_LIST}[l_partkey % 8 + 1] END AS leaf, {LEAF_LIST}[l_suppkey % 8 + 1] AS other, l_discount < 0.02 AS wrong, l_quantity FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l.leaf IS NULL THEN 'leaf is unknown' WHEN wrong AND k.o <> l.o THEN 'operator is not the leaf''s' WHEN l_quantity > 45 THEN 'slot is not the leaf''s' END AS problem
        FROM m LEFT JOIN l ON l.leaf = m.leaf JOIN l k ON k.leaf = m.other""",
)
def n5(spark, sf):
    pick = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), (F.col(at) % 8).cast("int"))
    lines = table(spark, sf, "lineitem")
    leaf = F.when(F.col("l_quantity") < 2, "Unknown").otherwise(pick(NAMES, "l_partkey"))
    operator = pick([x[4] for x in facts.LEAVES], "l_partkey")
    other = pick([x[4] for x in facts.LEAVES], "l_suppkey")
    slot = F.when(F.col("l_quantity") > 45, "none").otherwise(pick([x[3] for x in facts.LEAVES], "l_partkey"))
    named = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", leaf.alias("leaf"), F.when(F.col("l_discount") < 0.02, other).otherwise(operator).alias("operator_id"), slot.alias("slot"))
    return facts.mutation_problems(named).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "problem")


@query(
    "n3_single_slot",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber <> 1 THEN 'one fact changes' WHEN l_quantity > 25 THEN 'one slot changes' WHEN l_returnflag <> 'N' THEN 'the slot is the planned one' END AS problem FROM lineitem",
)
def n3(spark, sf):
    paths = F.when(F.col("l_quantity") > 25, F.array(F.lit("fact.count"), F.lit("fact.order"))).otherwise(F.array(F.concat(F.lit("fact."), "l_returnflag")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", facts.single_slot_problem(F.col("l_linenumber"), paths, F.lit("N")).alias("problem"))


@query(
    "f14_memory_categories",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN ['global'] WHEN o_orderstatus = 'O' THEN [o_orderstatus, o_orderpriority] ELSE [o_orderpriority] END AS categories FROM orders""",
)
def f14_nested(spark, sf):
    text = F.expr("""CASE o_orderstatus WHEN 'F' THEN to_json(named_struct('other', named_struct('leaf_label', 'hidden'), 'leaf_label', ''))
                     WHEN 'O' THEN to_json(named_struct('facts', array(named_struct('leaf_label', o_orderstatus), named_struct('leaf_label', o_orderpriority), named_struct('leaf_label', o_orderstatus))))
                     ELSE to_json(named_struct('opportunities', named_struct('source_fact', named_struct('leaf_label', o_orderpriority)))) END""")  # fmt: skip
    return facts.memory_categories(table(spark, sf, "orders").select("o_orderkey", text.alias("t")), "o_orderkey", "t")


@query("s2_tolerant_lines", "SELECT event_id, user_id, event_type FROM events WHERE event_id % 7 <> 0 AND event_id % 7 <> 1 AND event_id % 7 <> 2")
def s2_tolerant(spark, sf):
    path, k = f"{scratch(spark)}/lines", F.col("event_id") % 7
    line = F.to_json(F.struct("event_id", "user_id", "event_type"))
    broken = F.when(k == 0, F.substring(line, 1, 12)).when(k == 1, F.lit("[1, 2]")).when(k == 2, F.lit("")).otherwise(line)
    table(spark, sf, "events").select(broken.alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, "event_id long, user_id long, event_type string", strict=False)


@query("s2b_json_values", "SELECT CAST(event_id AS VARCHAR) AS value FROM events WHERE event_id % 3 = 0 UNION ALL SELECT '[' || event_id || ',null]' FROM events WHERE event_id % 3 = 1")
def s2b(spark, sf):
    path, k = f"{scratch(spark)}/values", F.col("event_id") % 3
    line = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.lit("["), "event_id", F.lit(", null]"))).otherwise("{broken")
    table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return readers.read_json_values(spark, path).select(F.to_json("value").alias("value"))


@query("s3_k3_document", "SELECT s_nationkey AS nation, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ordinal, s_suppkey, s_name FROM supplier")
def s3(spark, sf):
    """A document for each nation, as a file of its own; `ordinal` is a row's place in its document."""
    path = f"{scratch(spark)}/documents"
    rows = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("videos"))
    rows.repartition("nation").write.partitionBy("nation").json(path)
    read = readers.read_document_rows(spark, path, "videos", "s_suppkey long, s_name string", also=["nation"])
    return read.withColumns({"ordinal": F.col("ordinal").cast("long"), "nation": F.col("nation").cast(rows.schema["nation"].dataType)})


@query("k3_pretty_document", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def k3(spark, sf):
    """A small table as one readable document, written by the driver and read as JSON of several lines."""
    path, nations = f"{scratch(spark)}/nations.json", table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    sinks.write_document(nations, path)
    return spark.read.schema(nations.schema).json(path, multiLine=True)


@query("s5_last_by_label", "SELECT p_brand AS label, CAST(p_size AS VARCHAR) AS filename, CAST(max(p_partkey) AS VARCHAR) AS part FROM part GROUP BY 1, 2")
def s5(spark, sf):
    path = f"{scratch(spark)}/labels"
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("label"), F.col("p_size").alias("filename"), F.col("p_partkey").alias("part"))
    rows.write.option("header", True).csv(path, compression="gzip")
    read = readers.read_csv(spark, path).withColumn("at", F.col("part").cast("long"))
    return readers.last_by_key(read, ["label", "filename"], "at").drop("at")


@query(
    "s7_s8_k6_event_files",
    "SELECT event_type, count(*) AS n, CAST(CASE event_type WHEN 'click' THEN 2 ELSE 1 END AS INT) AS places FROM events GROUP BY 1",
)
def s7(spark, sf):
    root = scratch(spark)
    events = table(spark, sf, "events").select("event_id", "event_type")
    sinks.append_events(events.where("event_type <> 'click'"), f"{root}/shard_0/events.jsonl")
    sinks.append_events(events.where("event_type = 'click' AND event_id % 2 = 0"), f"{root}/shard_1/events.jsonl")
    sinks.append_events(events.where("event_type = 'click' AND event_id % 2 = 1"), f"{root}/shard_1/events")
    read = readers.read_events(spark, readers.shard_roots(spark, root), "event_id long, event_type string")
    place = F.regexp_extract("event_file", r"(shard_\d/events(?:\.jsonl)?)/", 1)
    return read.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(place).cast("int").alias("places"))


@query("s1_s7_pairs_in_file_order", f"WITH {PAIRS} SELECT event_id, user_id, seconds FROM p")
def s1_s7(spark, sf):
    """Events written as files that hold their users' lines in order; calls are paired by (file, byte offset), without a look at their times."""
    from ..operators.telemetry import pair_calls

    root = scratch(spark)
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("string").alias("at"))
    sinks.append_events(events.repartition("user_id").sortWithinPartitions("at", "event_id"), f"{root}/events")
    read = readers.read_events(spark, [root], "event_id long, user_id long, event_type string, at string", place=True).withColumn("at", F.to_timestamp_ntz("at"))
    kind = F.col("event_type")
    return pair_calls(read, keys=["event_file", "user_id"], order=["offset"], start=kind == "click", end=kind == "purchase", at="at").select("event_id", "user_id", "seconds")


@query("s9_s10_files", "SELECT n_name AS name, sha256(n_name || chr(10)) AS sha256, CAST(length(n_name) + 1 AS BIGINT) AS length FROM nation")
def s9(spark, sf):
    root = scratch(spark)
    table(spark, sf, "nation").select("n_name", F.col("n_name").alias("name")).repartition("n_name").write.partitionBy("name").text(f"{root}/files")
    listed = readers.list_files(spark, f"{root}/files", ["TXT"])
    name = F.url_decode(F.regexp_extract("path", r"name=([^/]+)/", 1))
    return listed.join(readers.file_digests(spark, f"{root}/files"), "path").select(F.regexp_replace(name, "%20", " ").alias("name"), "sha256", "length")


@query(
    "s14_verified_policies",
    """SELECT 'rule=' || n_nationkey AS folder, CASE WHEN n_nationkey % 5 = 0 THEN 'digest differs' WHEN n_nationkey % 7 = 1 THEN 'unexpected' END AS problem, CASE WHEN n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 1 THEN n_name || chr(10) END AS content FROM nation
       UNION ALL SELECT 'rule=' || (1000 + r_regionkey), 'missing', NULL FROM region""",
)
def s14(spark, sf):
    """A policy of one file a nation, of which the table knows some, and others wrongly; it also knows files that are not there."""
    root, nations = f"{scratch(spark)}/policy", table(spark, sf, "nation")
    nations.select(F.col("n_nationkey").alias("rule"), "n_name").repartition("rule").write.partitionBy("rule").text(root)
    named = readers.list_files(spark, root, ["txt"]).select(F.regexp_extract("path", "(rule=[0-9]+/[^/]+)$", 1).alias("name"))
    key = F.regexp_extract("name", "rule=([0-9]+)/", 1).cast("long")
    digest = F.sha2(F.concat(F.when(key % 5 == 0, F.lit("changed ")).otherwise(""), "n_name", F.lit("\n")), 256)
    known = named.withColumn("n_nationkey", key).where("n_nationkey % 7 <> 1 or n_nationkey % 5 = 0").join(nations, "n_nationkey").select("name", digest.alias("sha256"))
    absent = table(spark, sf, "region").select(F.concat(F.lit("rule="), F.col("r_regionkey") + 1000, F.lit("/x.txt")).alias("name"), F.sha2("r_name", 256).alias("sha256"))
    checked = readers.verified_files(spark, root, known.unionByName(absent))
    return checked.select(F.regexp_extract("name", "^([^/]+)/", 1).alias("folder"), "problem", F.decode("content", "UTF-8").alias("content"))


@query("k7_k8_staged_release", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def k8(spark, sf):
    path, regions = f"{scratch(spark)}/release", table(spark, sf, "region")
    sinks.write_staged(regions, path, "parquet")
    sinks.write_staged(regions.where("r_regionkey > 1"), path, "parquet")
    return spark.read.parquet(path)


@query(
    "t2_snapshot_history",
    "SELECT 'target' AS reason, CAST(1 AS BIGINT) AS batches_then, CAST(4 AS BIGINT) AS batches, (SELECT count(*) FROM events) AS done, (SELECT sum(user_id) FROM events)::DOUBLE AS spent",
)
def t2_history(spark, sf):
    """A run that its target stops after the first batch, and one with higher limits that goes on where it stopped."""
    root, schema = scratch(spark), "event_type string, n long, users long"
    table(spark, sf, "events").select("event_type", F.col("user_id").alias("users")).repartition(4).write.parquet(f"{root}/in")

    def run(target: int) -> str | None:
        stream = spark.readStream.schema("event_type string, users long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        return state.guarded_snapshot(stream, state.count_fold(["event_type"], ["users"]), f"{root}/run", f"{root}/checkpoint", schema, spent=F.sum("users"), done=F.sum("n"), stop_at=float("inf"), target=target)

    history = lambda: spark.read.schema("batch long, spent double, done long, reason string").json(f"{root}/run/history")
    reason, then = run(1), history().count()
    run(10**15)
    return history().agg(F.lit(reason).alias("reason"), F.lit(then).cast("long").alias("batches_then"), F.count("*").alias("batches"), F.max("done").alias("done"), F.max("spent").alias("spent"))


@query(
    "t13_resume_migration",
    """SELECT o_orderkey AS video_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'pending' END AS state, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1 AND l_quantity > 40) AS n_outputs
       FROM orders""",
)
def t13(spark, sf):
    """A run carried over whole; one whose selection lacks a row is refused first."""
    orders = table(spark, sf, "orders")
    selection = orders.select(F.col("o_orderkey").alias("video_id"))
    results = orders.select(F.col("o_orderkey").alias("video_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("state"), F.lit(checks.table_digest(selection)).alias("selection_hash"))
    lines = table(spark, sf, "lineitem").where("l_linenumber = 1 AND l_quantity > 40")
    outputs = lines.select(F.col("l_orderkey").alias("video_id"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice").alias("output_id"))
    try:
        state.migrate_resume(selection.where("video_id <> 1"), results, outputs, "video_id")
    except ValueError:
        return state.migrate_resume(selection, results, outputs, "video_id").select("video_id", "state", "n_outputs")
    raise AssertionError("results of another selection were taken")


@query("s13_lookup_in_order", "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'")
def s13(spark, sf):
    from ..operators.ordering import number_rows

    held = state.lookup(table(spark, sf, "orders"), o_orderstatus="P", o_orderpriority="1-URGENT").select("o_orderkey", "o_orderdate")
    return number_rows(held, ["o_orderdate", "o_orderkey"])


@query("p4_public_input", "SELECT doc_id AS video_id, source AS source_path, lang AS task_type, row_number() OVER (ORDER BY doc_id) AS sequence FROM documents")
def p4(spark, sf):
    from ..operators.ordering import number_rows

    rows = number_rows(table(spark, sf, "documents"), ["doc_id"], "sequence")
    return facts.public_input(rows.withColumnsRenamed({"doc_id": "video_id", "source": "source_path", "lang": "task_type"}))
