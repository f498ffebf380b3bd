"""Telemetry over `events` (clicks as starts, purchases as ends) and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks, telemetry
from ..streaming import leases, state
from .catalog import query, table

START, END = F.col, F.col


def events(spark, sf):
    return table(spark, sf, "events")


def paired(spark, sf):
    return telemetry.pair_calls(events(spark, sf), keys=["user_id"], order=["ts", "event_id"], start=F.col("event_type") == "click", end=F.col("event_type") == "purchase", at="ts")


PAIRS = """m AS (SELECT *, sum(CASE event_type WHEN 'click' THEN 1 ELSE -1 END) OVER w AS s FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
     o AS (SELECT *, greatest(0, -min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS orphans FROM m),
     l AS (SELECT *, event_type = 'purchase' AND orphans > coalesce(lag(orphans) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS fresh FROM o),
     t AS (SELECT *, CASE WHEN NOT fresh THEN sum(CASE WHEN event_type = 'click' OR NOT fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS turn FROM l),
     p AS (SELECT e.event_id, e.user_id, e.ts AS ended_at, s.ts AS started_at, date_diff('microsecond', s.ts, e.ts) / 1e6 AS seconds FROM t e LEFT JOIN t s ON s.event_type = 'click' AND s.user_id = e.user_id AND s.turn = e.turn WHERE e.event_type = 'purchase')"""


@query("w9_fifo_pairing", f"WITH {PAIRS} SELECT event_id, user_id, started_at, ended_at, seconds FROM p")
def w9(spark, sf):
    return paired(spark, sf).select("event_id", "user_id", "started_at", "ended_at", "seconds")


@query("w10_unpaired_starts", "SELECT user_id, greatest(0, count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'purchase')) AS open FROM events GROUP BY 1")
def w10(spark, sf):
    return telemetry.unpaired_starts(events(spark, sf), ["user_id"], F.col("event_type") == "click", F.col("event_type") == "purchase")


@query(
    "a8_latency_summary",
    f"WITH {PAIRS} SELECT user_id % 10 AS bucket, count(seconds) AS n, round(avg(seconds), 6) AS mean_s, round(quantile_cont(seconds, 0.5), 6) AS median_s, round(quantile_cont(seconds, 0.9), 6) AS p90_s, round(max(seconds), 6) AS max_s FROM p GROUP BY 1",
)
def a8(spark, sf):
    return telemetry.latency_summary(paired(spark, sf).withColumn("bucket", F.col("user_id") % 10), ["bucket"])


@query("a6_usage_by_role", "SELECT coalesce(nullif(json_extract_string(props, '$.device'), ''), event_type) AS role, count(*) AS calls, coalesce(sum(CAST(round(value) AS BIGINT)), 0)::BIGINT AS tokens FROM events GROUP BY 1")
def a6(spark, sf):
    rows = events(spark, sf).select("event_type", F.get_json_object("props", "$.device").alias("device"), F.round("value").cast("long").alias("tokens"))
    return telemetry.usage_by_role(rows, "device", "event_type", ["tokens"])


@query(
    "f8_cost_estimate",
    """WITH t AS (SELECT user_id, sum(CAST(floor(value * 100) AS BIGINT)) AS a, count(*) AS c, count(*) FILTER (event_type = 'view') AS o FROM events GROUP BY 1),
            u AS (SELECT user_id, ((a - least(a, c)) * 0.75 + least(a, c) * 0.075 + o * 3.75) / 1e6 AS usd FROM t)
       SELECT user_id, round(usd, 6) AS usd, round(usd / 0.65, 6) AS aud, round(usd / 0.65 * 1.1, 6) AS aud_with_gst FROM u""",
)
def f8(spark, sf):
    sums = events(spark, sf).groupBy("user_id").agg(F.sum(F.floor(F.col("value") * 100)).alias("a"), F.count("*").alias("c"), F.count_if(F.col("event_type") == "view").alias("o"))
    cost = telemetry.call_cost(F.col("a"), F.col("c"), F.col("o"), F.lit(0), plain_rate=0.75, cached_rate=0.075, out_rate=3.75, usd_per_aud=0.65, gst=0.1)
    return sums.select("user_id", *[c.alias(k) for k, c in cost.items()])


@query(
    "a13_run_progress",
    """SELECT count(DISTINCT user_id) AS items, count(*) FILTER (event_type = 'purchase') AS done, min(ts) AS first_at, max(ts) AS last_at, round(date_diff('microsecond', min(ts), max(ts)) / 3.6e9, 6) AS hours,
              round(count(*) FILTER (event_type = 'purchase') / round(date_diff('microsecond', min(ts), max(ts)) / 3.6e9, 6), 6) AS per_hour FROM events""",
)
def a13(spark, sf):
    return telemetry.run_progress(events(spark, sf), item="user_id", at="ts", done=F.col("event_type") == "purchase")


@query(
    "a14_session_delta",
    """WITH n AS (SELECT count(*) AS items, max(ts) AS at FROM events), b AS (SELECT count(*) AS items, max(ts) AS at FROM events WHERE ts < TIMESTAMP '2024-01-15'),
            d AS (SELECT n.items - b.items AS new_items, date_diff('microsecond', b.at, n.at) / 3.6e9 AS hours FROM n, b)
       SELECT new_items, hours, CASE WHEN new_items >= 10 THEN round(new_items / hours, 6) END AS per_hour FROM d""",
)
def a14(spark, sf):
    now = events(spark, sf).agg(F.count("*").alias("items"), F.max("ts").alias("at"))
    base = events(spark, sf).where("ts < timestamp_ntz'2024-01-15'").agg(F.count("*").alias("base_items"), F.max("ts").alias("base_at"))
    return telemetry.session_delta(now, base)


@query("t3_session_pairing", f"WITH {PAIRS.replace('FROM events WHERE', 'FROM events WHERE ts >= TIMESTAMP ' + chr(39) + '2024-01-10' + chr(39) + ' AND')} SELECT user_id, count(*) AS ends, count(seconds) AS closed FROM p GROUP BY 1")
def t3(spark, sf):
    later = events(spark, sf).where("ts >= timestamp_ntz'2024-01-10'")
    pairs = telemetry.pair_calls(later, keys=["user_id"], order=["ts", "event_id"], start=F.col("event_type") == "click", end=F.col("event_type") == "purchase", at="ts")
    return pairs.groupBy("user_id").agg(F.count("*").alias("ends"), F.count("seconds").alias("closed"))


@query(
    "w12_last_per_category",
    "WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) <= 3) SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM k",
)
def w12(spark, sf):
    return telemetry.last_per_category(events(spark, sf).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id", 3)


@query(
    "f17_lease_reusable",
    "SELECT event_id, (event_type = 'view' OR (event_type = 'click' AND date_diff('microsecond', ts, TIMESTAMP '2024-01-15') / 6e7 < 15)) AND date_diff('microsecond', TIMESTAMP '2024-01-15', ts) / 6e7 > 120 AS reusable FROM events",
)
def f17(spark, sf):
    kind = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "pending").otherwise("gone")
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    return events(spark, sf).select("event_id", telemetry.lease_reusable(kind, F.col("ts"), F.col("ts"), now).alias("reusable"))


@query(
    "t5_lease_claims",
    """WITH s AS (SELECT user_id, max(event_id) AS e, min(ts) AS c, max(ts) AS x FROM events WHERE event_type = 'view' GROUP BY 1)
       SELECT user_id AS lease_id, date_diff('microsecond', TIMESTAMP '2024-01-29', x) / 6e7 > 120 AS reused FROM s""",
)
def t5(spark, sf):
    held = events(spark, sf).where("event_type = 'view'").groupBy(F.col("user_id").alias("lease_id")).agg(F.lit("active").alias("state"), F.min("ts").alias("created_at"), F.max("ts").alias("expires_at"), F.lit("memory://held").alias("uri"))
    now = F.lit("2024-01-29").cast("timestamp_ntz")
    wanted = held.select("lease_id", F.lit("pending").alias("state"), now.alias("created_at"), now.alias("expires_at"), F.lit("memory://new").alias("uri"))
    return state.claim_leases(held, wanted, now).select("lease_id", "reused")


@query(
    "t5_lease_stream",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'view' THEN ts + INTERVAL 4 HOUR WHEN 'click' THEN ts + INTERVAL 15 MINUTE END AS until, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
            r AS (SELECT user_id, i, event_id, ts, until AS held, event_id::VARCHAR AS uri, 'claimed' AS outcome FROM e WHERE i = 1
                  UNION ALL
                  SELECT e.user_id, e.i, e.event_id, e.ts, CASE WHEN e.ts < r.held THEN r.held ELSE e.until END, CASE WHEN e.ts < r.held THEN r.uri ELSE e.event_id::VARCHAR END, CASE WHEN e.ts < r.held THEN 'reused' ELSE 'claimed' END
                  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
       SELECT user_id AS lease_id, event_id AS request_id, ts AS at, uri, outcome FROM r
       UNION ALL SELECT user_id, NULL, held, uri, 'expired' FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1) WHERE held <= (SELECT max(ts) FROM events)""",
)
def t5_stream(spark, sf):
    """Every event asks for its user's lease; views get one for six hours, clicks a pending one, others none that lasts. One batch, so requests come in their order."""
    from .more_queries import scratch

    root = scratch(spark)
    asked = events(spark, sf).withColumn("at", F.col("ts").cast("timestamp"))
    expires = F.when(F.col("event_type") == "view", F.col("at") + F.expr("INTERVAL 6 HOURS"))
    state_of = F.when(F.col("event_type") == "view", "active").when(F.col("event_type") == "click", "pending").otherwise("failed")
    asked.select(F.col("user_id").alias("lease_id"), F.col("event_id").alias("request_id"), "at", state_of.alias("state"), expires.alias("expires_at"), F.col("event_id").cast("string").alias("uri")).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(leases.REQUESTS).option("maxFilesPerTrigger", 1_000_000).parquet(f"{root}/in")
    with leases.keyed_store(spark):
        query = leases.lease_decisions(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("t6_reservations", "SELECT DISTINCT o_orderkey AS fact_id, CAST(o_custkey AS VARCHAR) AS key, o_orderstatus AS cell FROM orders WHERE o_orderkey % 3 <> 0")
def t6(spark, sf):
    wanted = table(spark, sf, "orders").select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").cast("string").alias("key"), F.col("o_orderstatus").alias("cell"))
    return state.reserve_many(wanted.where("fact_id % 3 = 0"), wanted)


@query("t10_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id % 3 <> 0)")
def t10(spark, sf):
    """Results know their selection by its digest; every third is of a selection in which one cell differs."""
    selection = table(spark, sf, "documents").select("doc_id", "lang")
    other = selection.withColumn("lang", F.when(F.col("doc_id") == 1, "xx").otherwise(F.col("lang")))
    of = F.when(F.col("doc_id") % 3 == 0, checks.table_digest(other)).otherwise(checks.table_digest(selection.repartition(7)))
    results = table(spark, sf, "labels").select("doc_id", of.alias("selection_hash"), F.when(F.col("quality") == 1, "complete").otherwise("running").alias("state"))
    return state.pending_after_resume(selection, results, "doc_id").select("doc_id")


@query("t11_memory_append", "SELECT DISTINCT event_id AS record_id, ts AS at, unnest([event_type, CASE WHEN value > 50 THEN 'large' ELSE event_type END]) AS category FROM events")
def t11(spark, sf):
    rows = events(spark, sf).select(F.col("event_id").alias("record_id"), F.col("ts").alias("at"), F.array("event_type", F.when(F.col("value") > 50, "large").otherwise(F.col("event_type"))).alias("categories"))
    return state.append_memory(spark.createDataFrame([], "record_id long, at timestamp_ntz, category string"), rows)


@query("t12_repair_interrupted", "SELECT doc_id, CASE WHEN toxic = 1 THEN 'pending' ELSE 'complete' END AS state, CASE WHEN toxic = 1 THEN greatest(0, quality - 1) ELSE quality END AS attempts FROM labels")
def t12(spark, sf):
    status = table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "running").otherwise("complete").alias("state"), F.col("quality").alias("attempts"))
    return state.repair_interrupted(status)


@query("t2_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def t2(spark, sf):
    return state.windowed_counts(events(spark, sf), "ts", ["event_type"], width="1 day")
