"""Gates, projections, selections with fallbacks, files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.json_schema import schema_violation
from ..operators import curation, facts
from ..operators.ordering import remove_at_exit
from ..sources import readers, sinks
from ..streaming import state
from .catalog import query, table


def scratch(spark) -> str:
    """A folder of its own below the one that driver and executors share; it goes as the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{shared.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    return path


@query("p1_public_projection", "SELECT '1' AS schema_version, o_orderkey AS pair_id, o_custkey AS media, o_orderstatus AS task_type, o_orderpriority AS question, 'a' AS answer, 'b' AS counterfactual_answer, 'l' AS leaf_label, 's' AS conflict_slot FROM orders")
def p1(spark, sf):
    named = {"schema_version": F.lit("1"), "pair_id": F.col("o_orderkey"), "media": F.col("o_custkey"), "task_type": F.col("o_orderstatus"), "question": F.col("o_orderpriority"), "answer": F.lit("a"), "counterfactual_answer": F.lit("b"), "leaf_label": F.lit("l"), "conflict_slot": F.lit("s")}
    rows = table(spark, sf, "orders").select("o_totalprice", *[c.alias(k) for k, c in named.items()])
    return facts.public_projection(rows)


@query("p2_exact_keys", "SELECT event_id, list_sort(json_keys(props)) = list_sort(json_keys((SELECT props FROM events ORDER BY event_id LIMIT 1))) AS exact FROM events")
def p2(spark, sf):
    events = table(spark, sf, "events")
    first = events.orderBy("event_id").select(F.json_object_keys("props")).first()[0]
    return events.select("event_id", facts.exact_keys(F.col("props"), first).alias("exact"))


SLOT_OF = {leaf: slot for _, leaf, _, slot, _ in facts.LEAVES}

#: A pair's contract: conditional slots, nested media, facts with times.
PAIR_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "required": ["pair_id", "media", "leaf_label", "conflict_slot", "facts"],
    "properties": {
        "pair_id": {"type": "string", "minLength": 1},
        "media": {
            "type": "object",
            "required": ["uri", "modalities"],
            "properties": {"uri": {"type": "string", "pattern": "^media://"}, "modalities": {"type": "array", "minItems": 1, "uniqueItems": True, "items": {"enum": ["visual", "speech_audio"]}}},
            "additionalProperties": False,
        },
        "leaf_label": {"enum": list(SLOT_OF)},
        "conflict_slot": {"enum": list(SLOT_OF.values())},
        "facts": {"type": "array", "items": {"type": "object", "required": ["start"], "properties": {"start": {"type": "number", "minimum": 0}, "accepted": {"const": True}}}},
    },
    "allOf": [{"if": {"properties": {"leaf_label": {"const": leaf}}}, "then": {"properties": {"conflict_slot": {"const": slot}}}} for leaf, slot in SLOT_OF.items()],
}


@query(
    "p3_schema_validation",
    """WITH l AS (SELECT l_orderkey, l_quantity, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem),
            w AS (SELECT l_orderkey, min({'i': i, 'path': '$.facts[' || i || CASE WHEN l_quantity < 3 THEN '].start' ELSE '].accepted' END, 'rule': CASE WHEN l_quantity < 3 THEN 'minimum' ELSE 'const' END}) FILTER (l_quantity < 3 OR l_returnflag = 'R') AS first FROM l GROUP BY 1)
       SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '$.pair_id' WHEN w.l_orderkey IS NULL THEN '$.facts' WHEN o_orderkey % 7 = 0 THEN '$.media.uri' WHEN o_orderkey % 5 = 0 THEN '$.media.modalities'
                   WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN '$.media.modalities[1]' WHEN first IS NOT NULL THEN first.path WHEN o_orderkey % 13 = 0 THEN '$.extra' WHEN o_orderkey % 3 = 0 AND o_orderkey % 8 <> 1 THEN '$.conflict_slot' END AS path,
              CASE WHEN o_orderkey % 11 = 0 OR w.l_orderkey IS NULL THEN 'required' WHEN o_orderkey % 7 = 0 THEN 'pattern' WHEN o_orderkey % 5 = 0 THEN 'uniqueItems'
                   WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'enum' WHEN first IS NOT NULL THEN first.rule WHEN o_orderkey % 13 = 0 THEN 'additionalProperties' WHEN o_orderkey % 3 = 0 AND o_orderkey % 8 <> 1 THEN 'const' END AS rule
       FROM orders LEFT JOIN w ON l_orderkey = o_orderkey""",
)
def p3(spark, sf):
    k, order = F.col("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    fact = F.struct((F.col("l_quantity") - 3).alias("start"), (F.col("l_returnflag") != "R").alias("accepted"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct(order.alias("at"), fact.alias("fact")))).alias("f"))
    leaves, slots = (F.array(*map(F.lit, x)) for x in (SLOT_OF, SLOT_OF.values()))
    second = F.when((F.col("o_orderstatus") == "P") & (k % 2 == 0), "smell").otherwise("speech_audio")
    media = F.struct(F.when(k % 7 == 0, "http://x").otherwise(F.concat(F.lit("media://"), "o_custkey")).alias("uri"), F.when(k % 5 == 0, F.array(F.lit("visual"), F.lit("visual"))).otherwise(F.array(F.lit("visual"), second)).alias("modalities"))
    parts = {
        "pair_id": F.when(k % 11 != 0, k.cast("string")), "media": media, "leaf_label": F.get(leaves, (k % 8).cast("int")), "conflict_slot": F.get(slots, F.when(k % 3 == 0, 1).otherwise(k % 8).cast("int")),
        "facts": F.col("f.fact"), "extra": F.when(k % 13 == 0, 1),
    }
    # Merged: a side that is sent leaves the few tasks that read the other one with all texts and their checks.
    documents = table(spark, sf, "orders").join(lines.hint("merge"), "o_orderkey", "left").select("o_orderkey", F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])).alias("text"))
    return documents.select("o_orderkey", schema_violation(F.try_parse_json("text"), PAIR_SCHEMA).alias("v")).select("o_orderkey", "v.path", "v.rule")


@query("p5_visible_columns", "SELECT * FROM region")
def p5(spark, sf):
    return facts.visible_columns(table(spark, sf, "region").withColumn("_rank", F.lit(1)).withColumn("_seed", F.lit("x")))


@query("p8_shape", "SELECT p_partkey, p_size * 1000 AS pixels, round(p_size * 10 / 100.0, 6) AS aspect FROM part")
def p8(spark, sf):
    return table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1000).alias("pixels"), F.round(F.col("p_size") * 10 / 100.0, 6).alias("aspect"))


SLOTS = "['existence', 'category', 'count', 'attribute_value', 'relation_predicate', 'predicate', 'order', 'camera_predicate']"


@query(
    "p12_pair_invariants",
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN 'one fact and one slot' WHEN l_returnflag = 'R' THEN 'single error'
              WHEN l_suppkey % 9 = 0 OR l_suppkey % 8 <> l_partkey % 8 THEN 'leaf and slot' WHEN l_linestatus = 'O' AND l_partkey % 2 = 0 THEN 'changed slot' END AS problem FROM lineitem""",
)
def p12(spark, sf):
    slots = F.array(*[F.lit(x[3]) for x in facts.LEAVES])
    pick = lambda c: F.element_at(slots, (c % 8 + 1).cast("int"))
    one = F.when(F.col("l_linenumber") <= 3, 1).otherwise(2)
    errors = F.when(F.col("l_returnflag") == "R", 1)
    leaf = F.when(F.col("l_suppkey") % 9 != 0, "leaf")
    path = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("facts[0]."), F.when(F.col("l_partkey") % 2 == 0, "other").otherwise(pick(F.col("l_partkey")))))
    problem = facts.pair_problem(one, one, F.lit(0), F.lit(1), errors, leaf, pick(F.col("l_partkey")), path, pick(F.col("l_suppkey")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", problem.alias("problem"))


@query("p17_leaf_slot", f"SELECT l_orderkey, l_linenumber, l_suppkey % 8 = l_partkey % 8 AS fits FROM lineitem WHERE {SLOTS}[l_partkey % 8 + 1] IS NOT NULL")
def p17(spark, sf):
    pick = lambda i, c: F.element_at(F.array(*[F.lit(x[i]) for x in facts.LEAVES]), (c % 8 + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pick(1, F.col("l_partkey")).alias("leaf"), pick(3, F.col("l_suppkey")).alias("said"))
    known = F.broadcast(facts.leaves(spark).select("leaf", "slot"))  # eight rows
    return rows.join(known, "leaf").select("l_orderkey", "l_linenumber", (F.col("said") == F.col("slot")).alias("fits"))


@query("p21_envelopes", "SELECT doc_id, CASE WHEN trim(source) = '' THEN 'video' WHEN lang = 'de' THEN 'payload' END AS problem FROM documents")
def p21(spark, sf):
    value = facts.envelope("scan", F.col("source"), ["reader"], F.array(F.col("lang")), F.when(F.col("lang") != "de", F.col("n_chars")))
    return table(spark, sf, "documents").withColumn("e", value).select("doc_id", facts.envelope_problem(F.col("e"), "scan").alias("problem"))


@query("p22_realization", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'counterfactual answer' WHEN o_orderkey % 3 = 0 THEN 'answers differ' END AS problem FROM orders")
def p22(spark, sf):
    other = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0), " ").when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise("none")
    return table(spark, sf, "orders").select("o_orderkey", facts.realization_problem(F.lit("q"), F.col("o_orderpriority"), other).alias("problem"))


@query("p24_evidence_routing", "SELECT doc_id, CASE WHEN toxic = 0 THEN 'accept' WHEN quality < 1 THEN 'retry' ELSE 'insufficient' END AS route FROM labels")
def p24(spark, sf):
    return table(spark, sf, "labels").select("doc_id", facts.route_evidence(F.col("toxic") == 0, F.col("quality")).alias("route"))


@query("p26_under_root", "SELECT page_id, starts_with(lower(url), 'https://www.') AS inside FROM pages")
def p26(spark, sf):
    path = F.regexp_replace("url", r"^(?i)(https://www)\.", "$1/")
    return table(spark, sf, "pages").select("page_id", curation.under_root(path, "HTTPS:\\\\www\\").alias("inside"))


@query("p28_grounded_verdict", "SELECT doc_id, CASE WHEN toxic = 0 AND quality = 0 THEN 'contradicted' WHEN toxic = 0 THEN 'supported' ELSE 'contradicted' END AS verdict FROM labels")
def p28(spark, sf):
    verdict = F.when(F.col("toxic") == 0, "supported").otherwise("contradicted")
    return table(spark, sf, "labels").select("doc_id", facts.grounded_verdict(verdict, F.col("quality") == 1, F.col("doc_id")).alias("verdict"))


@query("p29_nested_repair", "SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE lang END AS lang, greatest(0, quality - 1) AS attempts FROM documents JOIN labels USING (doc_id)")
def p29(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("r", F.struct("lang", "source", "quality"))
    fixed = facts.repair_nested(F.col("r"), drop=["source"], put={"lang": F.when(F.col("toxic") == 0, F.col("r.lang")), "attempts": F.greatest(F.lit(0), F.col("r.quality") - 1)})
    return joined.select("doc_id", fixed.alias("r")).select("doc_id", "r.lang", "r.attempts")


@query(
    "j10_candidate_lookups",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') THEN 'video is not in the manifest'
              WHEN NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_partkey = l.l_partkey AND f.l_quantity > 10) THEN 'fact is unknown'
              WHEN NOT EXISTS (SELECT 1 FROM lineitem f WHERE f.l_orderkey = l.l_orderkey AND f.l_partkey = l.l_partkey AND f.l_quantity > 10 AND f.l_tax > 0.02) THEN 'fact is not eligible' END AS problem FROM lineitem l""",
)
def j10(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("video_id", F.col("l_orderkey")).withColumn("fact_id", F.col("l_partkey"))
    manifest = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("video_id"))
    known = lines.where("l_quantity > 10")
    return facts.candidate_problems(lines, manifest, known, known.where("l_tax > 0.02")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "problem")


QUOTAS = """c AS (SELECT {k} AS k, count(*) AS w FROM documents GROUP BY 1), e AS (SELECT k, w, {t}.0 * w / sum(w) OVER () AS x FROM c),
            f AS (SELECT *, CAST(floor(x) AS BIGINT) AS b, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, {tie}) AS n FROM e)
            SELECT k, b + CASE WHEN n <= {t} - (SELECT sum(b) FROM f) THEN 1 ELSE 0 END AS quota FROM f"""


@query("o6_remainder_by_digest", "WITH " + QUOTAS.format(k="source", t=77, tie="sha256('42|cells|''' || k || '''')"))
def o6(spark, sf):
    counted = table(spark, sf, "documents").groupBy(F.col("source").alias("k")).agg(F.count("*").alias("w"))
    tie = F.sha2(F.concat(F.lit("42|cells|'"), "k", F.lit("'")), 256)  # the key as Python writes it
    return curation.largest_remainder(counted, weight="w", target=77, tie=[tie]).select("k", "quota")


@query("o7_remainder_by_place", "WITH " + QUOTAS.format(k="lang", t=31, tie="CASE k WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END"))
def o7(spark, sf):
    counted = table(spark, sf, "documents").groupBy(F.col("lang").alias("k")).agg(F.count("*").alias("w"))
    place = F.coalesce(F.nullif(F.array_position(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), F.col("k")), F.lit(0)), F.lit(9))
    return curation.largest_remainder(counted, weight="w", target=31, tie=[place]).select("k", "quota")


TURNS = "row_number() OVER (PARTITION BY {part}label ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY {part}label) AS best"


@query(
    "o12_take_with_fallback",
    f"""WITH RECURSIVE d AS (SELECT doc_id, lang = 'en' AS preferred, source AS label, doc_id % 150 AS parent, sha256(text) AS digest FROM documents),
            p AS (SELECT *, row_number() OVER (PARTITION BY preferred ORDER BY turn, best, label) AS n FROM (SELECT *, {TURNS.format(part="preferred, ")} FROM d)),
            a AS (SELECT doc_id, parent, digest, row_number() OVER (ORDER BY preferred DESC, n) AS seq FROM p WHERE n <= CASE WHEN preferred THEN 40 ELSE 60 END),
            b AS (SELECT doc_id, parent, digest, row_number() OVER (ORDER BY turn, best, label) AS n FROM (SELECT *, {TURNS.format(part="")} FROM d WHERE parent NOT IN (SELECT parent FROM a) AND digest NOT IN (SELECT digest FROM a))),
            s AS (SELECT * FROM a UNION ALL SELECT doc_id, parent, digest, n + (SELECT count(*) FROM a) FROM b WHERE n <= 100 - (SELECT count(*) FROM a)),
            m AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ids, CAST([] AS BIGINT[]) AS parents, CAST([] AS VARCHAR[]) AS digests
                  UNION ALL
                  SELECT seq, CASE WHEN again THEN ids ELSE list_append(ids, doc_id) END, CASE WHEN again THEN parents ELSE list_append(parents, parent) END, CASE WHEN again THEN digests ELSE list_append(digests, digest) END
                  FROM (SELECT m.*, s.*, list_contains(parents, parent) OR list_contains(digests, digest) AS again FROM m JOIN s ON seq = i + 1)),
            k AS (SELECT ids, parents, digests FROM m ORDER BY i DESC LIMIT 1),
            f AS (SELECT doc_id, row_number() OVER (ORDER BY turn, best, label) AS n FROM (SELECT d.*, {TURNS.format(part="")} FROM d, k WHERE NOT list_contains(parents, parent) AND NOT list_contains(digests, digest)))
       SELECT unnest(ids) AS doc_id, unnest(range(1, len(ids) + 1)) AS position FROM k UNION ALL SELECT doc_id, n + (SELECT len(ids) FROM k) FROM f WHERE n <= 100 - (SELECT len(ids) FROM k)""",
)
def o12(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.col("source").alias("label"), (F.col("doc_id") % 150).alias("parent"), F.sha2("text", 256).alias("digest"))
    taken = curation.take_with_fallback(rows, preferred=F.col("lang") == "en", label="label", parent="parent", digest="digest", order=["doc_id"], total=100, most_preferred=40)
    return taken.select("doc_id", "position")


@query("o15_fixed_windows", "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 100 AS INT) AS window_no FROM orders")
def o15(spark, sf):
    rows = table(spark, sf, "orders").withColumn("n", F.row_number().over(Window.partitionBy("o_orderstatus").orderBy("o_orderkey")))
    return curation.fixed_windows(rows, "n", 100).select("o_orderkey", "window_no")


@query("o20_pending_first", "SELECT source, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) <= 3")
def o20(spark, sf):
    return curation.pending_first(table(spark, sf, "documents"), table(spark, sf, "labels"), key="doc_id", group="source", order=["n_chars", "doc_id"], k=3).select("source", "doc_id")


@query("u6_distinct_in_order", "SELECT doc_id, source || ',' || lang AS names FROM documents")
def u6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_distinct(F.array("source", "lang", "source", "lang")), ",").alias("names"))


@query("f7_folded_path", "SELECT page_id, lower(url) AS path FROM pages")
def f7(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.lower("url").alias("path"))


@query("f11_numeric", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(abs(ln(l_quantity / l_extendedprice)), 6) AS gap, round(exp(-l_discount), 6) AS odds, round(power(l_tax, 2) + power(l_discount, 2), 6) AS squares FROM lineitem")
def f11(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.abs(F.log(c("l_quantity") / c("l_extendedprice"))), 6).alias("gap"), F.round(F.exp(-c("l_discount")), 6).alias("odds"), F.round(c("l_tax") ** 2 + c("l_discount") ** 2, 6).alias("squares")
    )


@query("f14_categories", "SELECT event_id, list_sort(json_keys(props))[1] AS first_key, CAST(len(json_keys(props)) AS INT) AS n FROM events")
def f14(spark, sf):
    keys = F.array_sort(F.json_object_keys("props"))
    return table(spark, sf, "events").select("event_id", F.get(keys, 0).alias("first_key"), F.size(keys).alias("n"))


@query("s2_k2_json_lines_round_trip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def s2(spark, sf):
    path = f"{scratch(spark)}/customers"
    sinks.write_staged(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return readers.read_jsonl(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("s4_k4_csv_round_trip", "SELECT p_partkey, p_name, p_size FROM part")
def s4(spark, sf):
    path = f"{scratch(spark)}/parts"
    sinks.write_staged(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path, "csv", compression="gzip")
    return readers.read_csv(spark, path, "p_partkey long, p_name string, p_size int")


@query("k1_unique_append", "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de')")
def k1(spark, sf):
    path = f"{scratch(spark)}/ledger"
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    for lang in ("en", "de"):
        sinks.unique_append(docs.where(F.col("lang") == lang), path, "doc_id")
    try:
        sinks.unique_append(docs.where("lang <> 'fr'"), path, "doc_id")
    except sinks.AppendRejected:
        return readers.read_jsonl(spark, path, "doc_id long, lang string")
    raise AssertionError("a batch with known keys was taken")


@query("k5_artifacts", "SELECT DISTINCT 'events' AS dataset, event_type AS kind, sha256(props) AS digest, true AS valid FROM events")
def k5(spark, sf):
    path = f"{scratch(spark)}/artifacts"
    rows = table(spark, sf, "events").select(F.lit("events").alias("dataset"), F.col("event_type").alias("kind"), F.col("props").alias("content"))
    sinks.put_artifacts(rows.where("event_type <> 'view'"), path)
    return sinks.get_artifacts(spark, sinks.put_artifacts(rows, path), path).select("dataset", "kind", "digest", "valid")


@query("t1_stream_snapshot", "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def t1(spark, sf):
    root = scratch(spark)
    events = table(spark, sf, "events")
    events.select("event_type", F.col("user_id").alias("users")).repartition(4).write.parquet(f"{root}/in")
    stream = spark.readStream.schema("event_type string, users long").option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    state.snapshot_stream(stream, state.count_fold(["event_type"], ["users"]), f"{root}/snapshot", f"{root}/checkpoint", "event_type string, n long, users long").awaitTermination()
    return sinks.read_version(spark, f"{root}/snapshot", "event_type string, n long, users long")
