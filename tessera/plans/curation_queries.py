"""Curation over `documents`, `orders`, `lineitem`, `customer`, `supplier` and `part`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks, curation
from ..operators.ordering import number_rows
from .catalog import query, table


@query("a1_counts_by_fields", "SELECT concat_ws(' | ', lang, source) AS label, count(*) AS n FROM documents GROUP BY 1")
def a1(spark, sf):
    return curation.counts_by(table(spark, sf, "documents"), "lang", "source")


@query("a2_conditional_counts", "SELECT source, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (n_chars >= 500 AND n_chars < 5000) AS middle, count(*) FILTER (n_chars >= 5000) AS long FROM documents GROUP BY source")
def a2(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").groupBy("source").agg(F.count_if(n < 500).alias("short"), F.count_if((n >= 500) & (n < 5000)).alias("middle"), F.count_if(n >= 5000).alias("long"))


@query("a3_distinct_counts", "SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT sha256(text)) AS texts FROM documents GROUP BY lang")
def a3(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct(F.sha2("text", 256)).alias("texts"))


@query("a4_scalar_aggregates", "SELECT o_orderstatus, max(o_totalprice) AS most, min(o_totalprice) AS least, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY o_orderstatus")
def a4(spark, sf):
    p = "o_totalprice"
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.max(p).alias("most"), F.min(p).alias("least"), F.round(F.sum(p), 2).alias("total"), F.round(F.avg(p), 2).alias("mean"))


@query(
    "a5_distribution_zero_filled",
    """WITH d AS (SELECT DISTINCT r.r_name, o.o_orderstatus FROM region r, (SELECT DISTINCT o_orderstatus FROM orders) o),
       c AS (SELECT r_name, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_totalprice > 400000 GROUP BY 1, 2)
       SELECT d.r_name, d.o_orderstatus, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (r_name, o_orderstatus)""",
)
def a5(spark, sf):
    orders = table(spark, sf, "orders")
    dimension = table(spark, sf, "region").select("r_name").crossJoin(orders.select("o_orderstatus").distinct())  # two small dimensions
    joined = orders.where("o_totalprice > 400000").join(table(spark, sf, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf, "nation"), F.expr("c_nationkey = n_nationkey")).join(table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    counted = joined.groupBy("r_name", "o_orderstatus").agg(F.count("*").alias("n"))
    return dimension.join(counted, ["r_name", "o_orderstatus"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(
    "a7_distribution_shift",
    """WITH a AS (SELECT lang, count(*) * 100.0 / sum(count(*)) OVER () AS p FROM documents GROUP BY lang),
            b AS (SELECT lang, count(*) * 100.0 / sum(count(*)) OVER () AS p FROM documents WHERE n_chars > 1000 GROUP BY lang)
       SELECT round(max(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 6) AS shift_pp FROM a FULL JOIN b USING (lang)""",
)
def a7(spark, sf):
    docs = table(spark, sf, "documents")
    return curation.distribution_shift(docs, docs.where("n_chars > 1000"), ["lang"])


@query(
    "a9_group_vector",
    "SELECT l_orderkey, count(*) AS lines, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_returnflag = 'A') AS accepted, count(*) FILTER (l_returnflag = 'N') AS neither, min(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey",
)
def a9(spark, sf):
    flag = lambda x: F.count_if(F.col("l_returnflag") == x)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), flag("R").alias("returned"), flag("A").alias("accepted"), flag("N").alias("neither"), F.min("l_linenumber").alias("first_line"))


@query(
    "a10_release_stats",
    """WITH g AS (SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY 1, 2)
       SELECT lang, source, n, CAST(chars AS BIGINT) AS chars, round(n * 1.0 / sum(n) OVER (PARTITION BY lang), 6) AS share FROM g""",
)
def a10(spark, sf):
    g = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


SPLIT = "CASE doc_id % 5 WHEN 0 THEN 'eval' WHEN 1 THEN 'test' ELSE 'main' END"


def with_split(docs):
    return docs.withColumn("split", F.expr(SPLIT)).withColumn("digest", F.sha2("text", 256)).withColumn("opening", F.substring("text", 1, 40))


@query(
    "a11_cross_split_overlap",
    f"""WITH d AS (SELECT {SPLIT} AS split, sha256(text) AS digest, substr(text, 1, 40) AS opening FROM documents)
       SELECT 'digest' AS kind, count(*) AS n FROM (SELECT digest FROM d GROUP BY digest HAVING count(DISTINCT split) > 1)
       UNION ALL SELECT 'opening', count(*) FROM (SELECT opening FROM d GROUP BY opening HAVING count(DISTINCT split) > 1)""",
)
def a11(spark, sf):
    return checks.cross_split_overlap(with_split(table(spark, sf, "documents")), "split", ["digest", "opening"])


@query("a12_duplicate_groups", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def a12(spark, sf):
    return checks.duplicate_groups(table(spark, sf, "documents").withColumn("digest", F.sha2("text", 256)), "digest", "doc_id")


@query("a15_reason_histogram", "SELECT CASE WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def a15(spark, sf):
    reason = F.when(F.col("n_chars") < 200, "short").when(F.col("lang") != "en", "language")
    return table(spark, sf, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(
    "a16_named_checks",
    """SELECT 'ids are unique' AS name, count(DISTINCT doc_id) = count(*) AS passed FROM documents UNION ALL SELECT 'texts are there', bool_and(text IS NOT NULL) FROM documents
       UNION ALL SELECT 'texts are unique', count(DISTINCT sha256(text)) = count(*) FROM documents""",
)
def a16(spark, sf):
    rules = {"ids are unique": F.count_distinct("doc_id") == F.count("*"), "texts are there": F.bool_and(F.col("text").isNotNull()), "texts are unique": F.count_distinct(F.sha2("text", 256)) == F.count("*")}
    return checks.named_checks(table(spark, sf, "documents"), rules)


@query("a17_gate", "SELECT count(DISTINCT doc_id) = count(*) AND min(n_chars) > 0 AS passed, CASE WHEN min(n_chars) > 0 THEN '' ELSE 'lengths' END AS failed FROM documents")
def a17(spark, sf):
    return checks.audit(checks.named_checks(table(spark, sf, "documents"), {"ids": F.count_distinct("doc_id") == F.count("*"), "lengths": F.min("n_chars") > 0}))


@query("a18_squared_error", "WITH c AS (SELECT l_shipmode, n FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n FROM lineitem GROUP BY 1)) SELECT round(sum(power(n - (SELECT avg(n) FROM c), 2)), 3) AS score FROM c")
def a18(spark, sf):
    c = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    mean = F.avg("n").over(Window.partitionBy(F.lit(1)))  # three groups
    return c.withColumn("m", mean).agg(F.round(F.sum(F.pow(F.col("n") - F.col("m"), 2)), 3).alias("score"))


@query(
    "j1_three_key_exclusion",
    """WITH p AS (SELECT doc_id, sha256(text) AS digest, lower(source || '/' || lang) AS path FROM documents WHERE doc_id % 97 = 0)
       SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM p) AND sha256(text) NOT IN (SELECT digest FROM p) AND lower(source || '/' || lang) NOT IN (SELECT path FROM p)""",
)
def j1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.concat_ws("/", "source", "lang").alias("path"))
    return curation.exclude_prior(docs, docs.where("doc_id % 97 = 0"), row_id="doc_id", digest="digest", path="path").select("doc_id")


@query(
    "j2_exclusion_reasons",
    """WITH d AS (SELECT doc_id, sha256(text) AS digest, lower(source || '/' || lang) AS path FROM documents), p AS (SELECT * FROM d WHERE doc_id % 97 = 0),
            r AS (SELECT CASE WHEN doc_id IN (SELECT doc_id FROM p) THEN 'id' WHEN digest IN (SELECT digest FROM p) THEN 'digest' WHEN path IN (SELECT path FROM p) THEN 'path' END AS reason FROM d)
       SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
)
def j2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.concat_ws("/", "source", "lang").alias("path"))
    return curation.attribute_exclusions(docs, docs.where("doc_id % 97 = 0"), row_id="doc_id", digest="digest", path="path")


@query("j3_complete_lookup", "SELECT count(*) AS n, count(*) FILTER (o_orderkey IS NULL) AS missing, round(sum(o_totalprice), 2) AS total FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def j3(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice", "o_orderdate")
    found = checks.complete_lookup(table(spark, sf, "lineitem").select("l_orderkey"), orders, ["l_orderkey"], right_order=["o_orderdate"])
    return found.agg(F.count("*").alias("n"), F.count_if("_missing").alias("missing"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j4_left_annotation", "SELECT doc_id, coalesce(quality, -1) AS quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def j4(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "toxic")


@query("j5_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j5(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.expr("c_custkey = o_custkey"), "left_anti").select("c_custkey")


@query("j6_semi_join", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def j6(spark, sf):
    return table(spark, sf, "part").join(table(spark, sf, "lineitem").where("l_quantity > 45"), F.expr("p_partkey = l_partkey"), "left_semi").select("p_partkey")


@query(
    "j7_one_accepted_report",
    "SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1 AND bool_and(l_returnflag <> 'R')) ON o_orderkey = l_orderkey",
)
def j7(spark, sf):
    from ..operators.facts import accepted_once

    reports = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") != "R").alias("accepted"))
    return accepted_once(table(spark, sf, "orders").select("o_orderkey"), reports, ["o_orderkey"])


@query(
    "j12_greedy_matching",
    """WITH RECURSIVE n AS (SELECT row_number() OVER (ORDER BY c_custkey) AS turn, c_custkey AS addition, c_nationkey AS k, floor(c_acctbal / 2500) AS b, c_acctbal AS x FROM customer),
            e AS MATERIALIZED (SELECT addition, turn, s_suppkey AS removal, round(abs(x - s_acctbal), 2) AS cost FROM n JOIN supplier ON s_nationkey = k AND floor(s_acctbal / 2500) = b),
            l AS MATERIALIZED (SELECT turn, addition, list({'cost': cost, 'removal': removal} ORDER BY cost, removal) AS wanted FROM e GROUP BY ALL),
            t AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY turn) AS i FROM l),
            m AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS addition, CAST(NULL AS STRUCT(cost DOUBLE, removal BIGINT)) AS got
                  UNION ALL
                  SELECT i, CASE WHEN got IS NULL THEN used ELSE list_append(used, got.removal) END, addition, got
                  FROM (SELECT t.i, m.used, t.addition, list_filter(t.wanted, lambda w: NOT list_contains(m.used, w.removal))[1] AS got FROM m JOIN t ON t.i = m.i + 1))
       SELECT addition, got.removal AS removal, got.cost AS cost FROM m WHERE got IS NOT NULL""",
)
def j12(spark, sf):
    # Pairs meet in cells of nation and balance; a customer has its turn by key. Balances are in cents.
    cell = lambda nation, balance: [F.col(nation).alias("nation"), F.floor(F.col(balance) / 2500).alias("balance"), F.round(F.col(balance) * 100).cast("long").alias("at")]
    additions = table(spark, sf, "customer").select(F.col("c_custkey").alias("addition"), F.col("c_custkey").alias("turn"), *cell("c_nationkey", "c_acctbal"))
    removals = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("removal"), *cell("s_nationkey", "s_acctbal"))
    return curation.nearest_match(additions, removals, ["nation", "balance"]).withColumn("cost", F.col("cost") / 100)


@query(
    "j13_positional_zip",
    """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer), b AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS i FROM supplier)
       SELECT c_custkey, s_suppkey, i AS place FROM a JOIN b USING (i)""",
)
def j13(spark, sf):
    a = number_rows(table(spark, sf, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"]).select("place", "c_custkey")
    b = number_rows(table(spark, sf, "supplier").select("s_acctbal", "s_suppkey"), ["s_acctbal", "s_suppkey"]).select("place", "s_suppkey")
    return a.join(b, "place")


@query(
    "j14_reconciliation",
    """WITH x AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1), o AS (SELECT o_orderkey, CAST(o_orderkey % 60 AS DOUBLE) AS q FROM orders)
       SELECT o_orderkey, CASE WHEN x.q IS NULL THEN 'missing' ELSE 'q differs' END AS problem FROM o LEFT JOIN x ON o_orderkey = l_orderkey WHERE x.q IS NULL OR x.q <> o.q""",
)
def j14(spark, sf):
    found = table(spark, sf, "lineitem").where("l_orderkey % 7 <> 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    expected = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 60).cast("double").alias("q"))
    return checks.reconcile(expected, found, "o_orderkey", {"q": "q"})


@query("j15_both_sides", "SELECT coalesce(o_orderkey, l_orderkey) AS key, o_orderkey IS NULL AS no_order, l_orderkey IS NULL AS no_lines FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0) FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey % 4 <> 0) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL")
def j15(spark, sf):
    a = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select("o_orderkey")
    b = table(spark, sf, "lineitem").where("l_orderkey % 4 <> 0").select("l_orderkey").distinct()
    both = a.join(b, F.expr("o_orderkey = l_orderkey"), "full")
    return both.select(F.coalesce("o_orderkey", "l_orderkey").alias("key"), F.col("o_orderkey").isNull().alias("no_order"), F.col("l_orderkey").isNull().alias("no_lines")).where("no_order or no_lines")


@query(
    "w1_quartiles",
    "SELECT doc_id, CAST(least(3, floor((row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1) * 4.0 / count(*) OVER (PARTITION BY lang))) AS INT) AS quartile FROM documents",
)
def w1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", curation.quartile(["lang"], ["n_chars", "doc_id"]).alias("quartile"))


@query("w2_keep_first", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1")
def w2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    return curation.keep_first(docs, ["digest"], ["doc_id"]).select("doc_id", "source")


@query("w3_best_per_parent", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w3(spark, sf):
    return curation.keep_first(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query(
    "w4_round_robin",
    "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS t, min(doc_id) OVER (PARTITION BY lang) AS b FROM documents) SELECT doc_id, lang, row_number() OVER (ORDER BY t, b, lang) AS position FROM r",
)
def w4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return curation.round_robin(docs, "lang", ["n_chars", "doc_id"], "doc_id").select("doc_id", "lang", "position")


@query("w5_interleave", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, source, row_number() OVER (ORDER BY n, source) AS position FROM r")
def w5(spark, sf):
    return curation.interleave(table(spark, sf, "documents").select("doc_id", "source"), "source", ["doc_id"])


@query(
    "w7_sequence_batches",
    "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS sequence FROM documents) SELECT doc_id, sequence, CAST((sequence - 1) // 10 AS INT) AS batch, CAST(sequence % 2 AS INT) AS turn, format('{}_{:04d}', lang, sequence) AS readable_id FROM r",
)
def w7(spark, sf):
    return curation.sequence_batches(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], 10).select("doc_id", "sequence", "batch", "turn", "readable_id")


@query(
    "o1_mixed_sort_rank",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 100",
)
def o1(spark, sf):
    top = table(spark, sf, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(100)  # the report's hundred
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")).alias("place"))


@query("o2_numeric_name_order", "SELECT source, coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT), -1) AS n, row_number() OVER (ORDER BY n, source) AS place FROM (SELECT DISTINCT source FROM documents)")
def o2(spark, sf):
    n = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long"), F.lit(-1)).cast("long")
    return table(spark, sf, "documents").select("source").distinct().withColumn("n", n).withColumn("place", F.row_number().over(Window.orderBy("n", "source")))


@query("o3_top_per_group", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5")
def o3(spark, sf):
    return curation.top_per_group(table(spark, sf, "documents"), ["source"], [F.desc("n_chars"), "doc_id"], 5).select("source", "doc_id")


@query("o4_stable_rank", "SELECT doc_id, sha256(concat_ws('|', '42', CAST(doc_id AS VARCHAR))) AS rank FROM documents")
def o4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", curation.stable_rank(F.lit("42"), F.col("doc_id").cast("string")).alias("rank"))


QUOTAS = """c AS (SELECT source, count(*) AS w FROM documents GROUP BY 1), e AS (SELECT source, w, 333.0 * w / sum(w) OVER () AS x FROM c),
            f AS (SELECT *, CAST(floor(x) AS BIGINT) AS b, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source) AS k FROM e),
            q AS (SELECT source, w, b + CASE WHEN k <= 333 - (SELECT sum(b) FROM f) THEN 1 ELSE 0 END AS quota FROM f)"""


@query("o5_largest_remainder", f"WITH {QUOTAS} SELECT source, w, quota FROM q")
def o5(spark, sf):
    counted = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("w"))
    return curation.largest_remainder(counted, weight="w", target=333, tie=["source"])


@query(
    "o8_stratified_sample",
    f"WITH {QUOTAS} SELECT doc_id, source FROM documents JOIN q USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) <= quota",
)
def o8(spark, sf):
    return curation.stratified_sample(table(spark, sf, "documents"), ["source"], "doc_id", 333, "42").select("doc_id", "source")


@query("o9_short_cells", "WITH h AS (SELECT lang, count(*) AS available FROM documents GROUP BY 1), t AS (SELECT unnest(['en', 'de', 'it']) AS lang, unnest([10, 1000000, 5]) AS target) SELECT lang, coalesce(available, 0) AS available, CAST(target AS BIGINT) AS target, CASE WHEN target IS NULL THEN 'unexpected' ELSE 'short' END AS problem FROM h FULL JOIN t USING (lang) WHERE target IS NULL OR coalesce(available, 0) < target")
def o9(spark, sf):
    targets = spark.createDataFrame([("en", 10), ("de", 1000000), ("it", 5)], "lang string, target long")
    return curation.short_cells(table(spark, sf, "documents"), targets, ["lang"])


@query(
    "o10_faithful_relative",
    """WITH s AS (SELECT source, count(*) AS supply FROM documents GROUP BY 1),
            d AS (SELECT doc_id, doc_id % 50 AS video, source, coalesce(CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 3 AS have, supply, sha256(concat_ws('|', CAST(doc_id % 50 AS VARCHAR), CAST(doc_id AS VARCHAR), source, '7')) AS h FROM documents JOIN s USING (source)),
            a AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY video, source ORDER BY have, supply, h, doc_id) = 1),
            b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY video ORDER BY have, supply, h, doc_id) <= 2)
       SELECT doc_id, video, source FROM b ORDER BY have, supply, h, doc_id LIMIT 60""",
)
def o10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 50).alias("video"), "source")
    counts = docs.select("source").distinct().withColumn("n", F.coalesce(F.regexp_extract("source", "([0-9]+)", 1).try_cast("long"), F.lit(0)) % 3)
    return curation.faithful_relative(docs, counts, video="video", fact="doc_id", leaf="source", seed="7", cap=2, target=60)


@query(
    "o11_smooth_deficit_order",
    """WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
       SELECT doc_id, lang, row_number() OVER (ORDER BY CAST(2 * k - 1 AS DOUBLE) / n, lang NULLS FIRST) - 1 AS position FROM t""",
)
def o11(spark, sf):
    return curation.smooth_order(table(spark, sf, "documents").select("doc_id", "lang"), "lang", [curation.stable_rank(F.lit("42"), F.col("doc_id").cast("string")), "doc_id"])


@query(
    "o13_removal_pool",
    "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_extendedprice, l_orderkey, l_linenumber) <= 3",
)
def o13(spark, sf):
    pool = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return curation.top_per_group(pool, ["l_suppkey"], [F.desc("l_discount"), "l_extendedprice", "l_orderkey", "l_linenumber"], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query(
    "o14_match_cost",
    """SELECT l_orderkey, l_linenumber, round(CASE WHEN l_returnflag <> o_orderstatus THEN 10 ELSE 0 END + 3 * abs(ln(greatest(l_quantity, 1e-9) / greatest(p_size, 1e-9))) + 1.5 * abs(ln(greatest(l_discount, 0.25) / greatest(l_tax, 0.25)))
              + 0.35 * abs(ln(greatest(l_extendedprice, 1) / greatest(p_retailprice, 1))) + 0.20 * abs(ln(greatest(o_totalprice, 1) / greatest(l_extendedprice, 1))), 6) AS cost
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
)
def o14(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey")).join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    c = F.col
    cost = curation.match_cost((c("l_quantity"), c("p_size")), (c("l_discount"), c("l_tax")), (c("l_extendedprice"), c("p_retailprice")), (c("o_totalprice"), c("l_extendedprice")), (c("l_returnflag"), c("o_orderstatus")))
    return joined.select("l_orderkey", "l_linenumber", F.round(cost, 6).alias("cost"))


@query(
    "o16_submission_plan",
    """WITH x AS (SELECT o_orderkey, CAST(780 + o_orderkey % 25 AS INT) AS current, CAST(o_orderkey % 4 AS INT) AS flying FROM orders),
            y AS (SELECT *, 800 - current AS rest, CASE WHEN 800 - current <= 0 THEN 0 WHEN 800 - current >= 4 THEN 2 ELSE 1 END AS wanted FROM x)
       SELECT o_orderkey, wanted, CAST(CASE WHEN rest <= 0 OR flying >= wanted THEN NULL WHEN wanted = 1 THEN least(2, rest) WHEN rest < (flying + 1) * 2 THEN NULL ELSE 2 END AS INT) AS cap FROM y""",
)
def o16(spark, sf):
    wanted, cap = curation.window_submission((F.lit(780) + F.col("o_orderkey") % 25).cast("int"), (F.col("o_orderkey") % 4).cast("int"), target=800, workers=2, cap=2)
    return table(spark, sf, "orders").select("o_orderkey", wanted.alias("wanted"), cap.alias("cap"))


@query("o19_annealed_split")
def o19(spark, sf):
    from ..operators.splits import split_groups

    parent = F.concat_ws("-", "l_suppkey", F.floor(F.col("l_orderkey") / 8).cast("string"))
    lines = table(spark, sf, "lineitem").withColumn("parent", parent).withColumn("task", F.pmod(F.col("l_suppkey"), F.lit(4)).cast("string"))
    groups = lines.groupBy("task", "parent").agg(F.sort_array(F.collect_list("l_returnflag")).alias("leaves"))
    return split_groups(groups, task="task", group="parent")


@query("u1_union_by_name", "SELECT doc_id, source, CAST(NULL AS VARCHAR) AS tag FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, NULL, 'labelled' FROM labels")
def u1(spark, sf):
    a = table(spark, sf, "documents").where("lang = 'de'").select("doc_id", "source")
    return a.unionByName(table(spark, sf, "labels").select("doc_id", F.lit("labelled").alias("tag")), allowMissingColumns=True)


@query("u2_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u2(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).intersect(table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))


@query("u3_remainder", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 48")
def u3(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k")).join(table(spark, sf, "lineitem").where("l_quantity > 48"), F.expr("k = l_partkey"), "left_anti")


@query(
    "u4_partition_check",
    "SELECT (SELECT count(*) FROM documents WHERE NOT (lang = 'en' OR n_chars < 800)) AS missing, CAST(0 AS BIGINT) AS extra, (SELECT count(*) FROM documents WHERE lang = 'en' AND n_chars < 800) AS shared",
)
def u4(spark, sf):
    docs = table(spark, sf, "documents")
    return checks.partition_check(docs, [docs.where("lang = 'en'"), docs.where("n_chars < 800")], "doc_id")


@query(
    "u5_split_intersections",
    f"WITH h AS (SELECT DISTINCT {SPLIT} AS split, sha256(text) AS digest FROM documents) SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM h a JOIN h b USING (digest) WHERE a.split < b.split GROUP BY 1, 2",
)
def u5(spark, sf):
    return checks.split_intersections(with_split(table(spark, sf, "documents")), "split", "digest")


@query("p25_config_differences", "SELECT coalesce(a.n_name, b.c_mktsegment) AS key, a.v AS expected, b.v AS observed FROM (SELECT n_name, n_regionkey AS v FROM nation) a FULL JOIN (SELECT DISTINCT c_mktsegment, 1 AS v FROM customer) b ON n_name = c_mktsegment WHERE a.v IS DISTINCT FROM b.v")
def p25(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"))
    b = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("key"), F.lit(1).alias("value")).distinct()
    return checks.config_differences(a, b)
