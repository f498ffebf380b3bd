"""Facts, text functions and gates over rows derived from `documents`, `events`, `lineitem` and `conversations`."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts
from .catalog import query, table


def seconds(ts: str = "ts"):
    """Seconds since 2024 to the nearest whole one, halves to the even one, as the SQL casts them."""
    return F.rint(F.col(ts).cast("timestamp").cast("double")) - 1704067200


def spans(spark, sf, kind: str, width: str):
    rows = table(spark, sf, "events").where(F.col("event_type") == kind).select("user_id", F.col("event_id"), seconds().alias("s"))
    return rows.withColumn("e", F.col("s") + F.expr(width))


SECONDS = "CAST(epoch(ts) AS BIGINT) - 1704067200"


@query(
    "j8_overlap_join",
    f"""WITH a AS (SELECT user_id, event_id, CAST({SECONDS} AS DOUBLE) AS s, CAST({SECONDS} AS DOUBLE) + 3600 AS e FROM events WHERE event_type = 'click'),
             b AS (SELECT user_id, event_id AS other_id, CAST({SECONDS} AS DOUBLE) AS s, CAST({SECONDS} AS DOUBLE) + 7200 AS e FROM events WHERE event_type = 'view')
        SELECT a.user_id, event_id, other_id FROM a JOIN b ON a.user_id = b.user_id AND a.s <= b.e AND a.e >= b.s""",
)
def j8(spark, sf):
    left = spans(spark, sf, "click", "3600")
    right = spans(spark, sf, "view", "7200").select("user_id", F.col("event_id").alias("other_id"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return facts.overlap_join(left, right, ["user_id"], ("s", "e"), ("s2", "e2")).select("user_id", "event_id", "other_id")


@query("j9_overlap_predicate", "SELECT l_orderkey, l_linenumber, l_tax >= l_discount AND l_quantity >= l_linenumber AND l_discount <= l_quantity AND l_tax >= l_linenumber AS met FROM lineitem")
def j9(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", facts.overlaps(c("l_discount"), c("l_tax"), c("l_linenumber"), c("l_quantity")).alias("met"))


@query(
    "j11_taxonomy_consistency",
    """WITH b AS (SELECT p_partkey % 500 AS leaf, min(p_brand) AS fact_kind, min(p_type) AS slot FROM part GROUP BY 1), p AS (SELECT * FROM b WHERE leaf IN (SELECT l_partkey % 500 FROM lineitem WHERE l_quantity > 45)),
            o AS (SELECT p_partkey % 500 AS leaf, min(p_brand) AS fact_kind, min(p_type) FILTER (p_size > 5) AS slot FROM part GROUP BY 1)
       SELECT b.leaf FROM b LEFT JOIN p ON p.leaf = b.leaf AND p.fact_kind = b.fact_kind AND p.slot = b.slot LEFT JOIN o ON o.leaf = b.leaf AND o.fact_kind = b.fact_kind AND o.slot = b.slot WHERE p.leaf IS NULL OR o.leaf IS NULL""",
)
def j11(spark, sf):
    """A taxonomy of parts against the plan of the lines and operators of the larger parts."""
    part = table(spark, sf, "part").withColumn("leaf", F.col("p_partkey") % 500)
    base = part.groupBy("leaf").agg(F.min("p_brand").alias("fact_kind"), F.min("p_type").alias("slot"))
    lines = table(spark, sf, "lineitem").where("l_quantity > 45").select((F.col("l_partkey") % 500).alias("leaf")).distinct()
    operators = part.groupBy("leaf").agg(F.min("p_brand").alias("fact_kind"), F.min(F.when(F.col("p_size") > 5, F.col("p_type"))).alias("slot"))
    return facts.taxonomy_mismatches(base, base.join(lines, "leaf", "left_semi"), operators)


KINDS = "['entity_existence', 'entity_category', 'entity_quantity', 'attribute_value', 'static_relation', 'action_predicate', 'temporal_relation', 'camera_predicate']"
NAMES = "['EntityExistence', 'EntityCategory', 'EntityQuantity', 'AttributeValue', 'StaticRelation', 'ActionPredicate', 'TemporalRelation', 'CameraPredicate']"


def derived_facts(spark, sf):
    kinds = F.array(*[F.lit(k[2]) for k in facts.LEAVES])
    verdict = F.when(F.col("l_linestatus") == "O", "supported").otherwise("contradicted")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.element_at(kinds, (F.col("l_partkey") % 8 + 1).cast("int")).alias("fact_kind"), (F.col("l_returnflag") != "R").alias("accepted"), (F.col("l_quantity") > 5).alias("evaluable"), F.floor(F.col("l_discount") * 100).alias("alternatives"), verdict.alias("verdict")
    )


@query(
    "p10_eligibility",
    f"""WITH f AS (SELECT l_orderkey, l_linenumber, {NAMES}[l_partkey % 8 + 1] AS leaf_label,
                   concat_ws(';', CASE WHEN l_returnflag = 'R' THEN 'fact_reflection_missing' END, CASE WHEN NOT l_quantity > 5 THEN 'dependency_not_evaluable' END,
                             CASE WHEN NOT floor(l_discount * 100) >= 1 THEN 'no_grounded_counterfactual_alternative' END, CASE WHEN l_linestatus <> 'O' THEN 'source_fact_not_supported' END) AS r FROM lineitem)
        SELECT l_orderkey, l_linenumber, leaf_label, r = '' AS eligible, CASE WHEN r = '' THEN 'eligible' ELSE r END AS reason FROM f""",
)
def p10(spark, sf):
    return facts.eligibility(derived_facts(spark, sf)).select("l_orderkey", "l_linenumber", "leaf_label", "eligible", "reason")


@query(
    "p11_first_reason",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 3 THEN 'quantity' WHEN l_discount > 0.08 THEN 'discount' WHEN l_returnflag = 'R' THEN 'flag' END AS reason FROM lineitem",
)
def p11(spark, sf):
    checks = (("quantity", F.col("l_quantity") > 3), ("discount", F.col("l_discount") <= 0.08), ("flag", F.col("l_returnflag") != "R"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", facts.first_reason(*checks).alias("reason"))


@query(
    "p13_all_reasons",
    "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_linenumber <> 1 THEN 'changed_atomic_fact_count' END, CASE WHEN l_quantity <> 1 THEN 'changed_slot_count' END, CASE WHEN l_tax <> 0 THEN 'additional_error_count' END) AS failed FROM lineitem",
)
def p13(spark, sf):
    failed = facts.single_error_failures(changed_atomic_fact_count=F.col("l_linenumber"), changed_slot_count=F.col("l_quantity"), counterfactual_contradicted_claim_count=F.lit(1), additional_error_count=F.col("l_tax"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(failed, ",").alias("failed"))


@query("p6_eligibility_flags", "SELECT doc_id, n_chars BETWEEN 300 AND 6000 AS length_ok, lang IN ('en', 'de') AS lang_ok, n_chars BETWEEN 300 AND 6000 AND lang IN ('en', 'de') AS eligible FROM documents")
def p6(spark, sf):
    length, lang = F.col("n_chars").between(300, 6000), F.col("lang").isin("en", "de")
    return table(spark, sf, "documents").select("doc_id", length.alias("length_ok"), lang.alias("lang_ok"), (length & lang).alias("eligible"))


@query(
    "p7_resolution_tier",
    "SELECT p_partkey, CASE WHEN p_size * 30 <= 360 THEN 'height_le_360' WHEN p_size * 30 <= 720 THEN 'height_361_720' ELSE 'height_gt_720' END AS tier, CASE WHEN p_size * 30 > 900 THEN 'landscape' WHEN p_size * 30 < 900 THEN 'portrait' ELSE 'square' END AS orientation FROM part",
)
def p7(spark, sf):
    side = F.col("p_size") * 30
    return table(spark, sf, "part").select("p_partkey", T.resolution_tier(side).alias("tier"), T.orientation(side, F.lit(900)).alias("orientation"))


@query("p9_derived_flag", "SELECT doc_id, (n_chars > 2000 AND lang = 'en') OR coalesce(toxic = 1, false) AS flagged FROM documents LEFT JOIN labels USING (doc_id)")
def p9(spark, sf):
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return joined.select("doc_id", (((F.col("n_chars") > 2000) & (F.col("lang") == "en")) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("flagged"))


@query("p14_evidence_gate", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN 'required modalities are not registered' WHEN event_type = 'error' THEN 'required modalities must be allowed' WHEN value > 90 THEN 'cross-modal evidence is unresolved' END AS reason FROM events")
def p14(spark, sf):
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    reason = facts.evidence_gate(F.array("event_type"), words("view"), words("view", "click"), words("view", "click", "error"), F.when(F.col("value") > 90, "unknown").otherwise("consistent"))
    return table(spark, sf, "events").select("event_id", reason.alias("reason"))


@query("p15_windows_inside", "SELECT o_orderkey, bool_and(l_linenumber - 1 >= 0 AND l_quantity > l_linenumber - 1 AND l_quantity <= 45) AS inside FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def p15(spark, sf):
    listed = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct((F.col("l_linenumber") - 1).alias("start_ms"), F.col("l_quantity").alias("end_ms"))).alias("w"))
    return listed.join(table(spark, sf, "orders"), "o_orderkey", "left_semi").select("o_orderkey", facts.windows_inside(F.col("w"), F.lit(45)).alias("inside"))


@query("p16_leaf_resolution", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN {NAMES}[l_partkey % 8 + 1] END AS leaf FROM lineitem")
def p16(spark, sf):
    rows = derived_facts(spark, sf).join(F.broadcast(facts.leaves(spark).select("fact_kind", "leaf")), "fact_kind", "left")  # eight rows
    return rows.select("l_orderkey", "l_linenumber", F.when(~F.col("accepted"), F.col("leaf")).alias("leaf"))


@query(
    "p18_answer_alignment",
    """SELECT conv_id, turn, CASE WHEN role = 'user' AND NOT regexp_matches(trim(text), '^(?:is|are|was|were|does|do|did|can|could|has|have|had)\\b', 'i') THEN 'question is not polar'
              WHEN role = 'user' AND NOT regexp_matches(trim(text), '^(?:yes|no),\\s+\\S+\\s+.+[.!?]\\z', 'i') THEN 'answer is not an explained yes or no'
              WHEN role <> 'user' AND regexp_matches(trim(text), '^(?:yes|no)\\b', 'i') THEN 'answer begins with yes or no' END AS problem FROM conversations""",
)
def p18(spark, sf):
    kind = F.when(F.col("role") == "user", "entity_existence").otherwise("attribute_value")
    form = T.answer_form(F.lit("video_qa"), kind)
    problem = T.alignment_problem(form, F.col("text"), F.col("text"), F.lit(True))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role").isNotNull(), problem).alias("problem"))


@query("p19_answer_form", "SELECT conv_id, turn, CASE role WHEN 'system' THEN 'caption_complete_sentence' WHEN 'user' THEN 'polar_explained_sentence' ELSE 'direct_complete_sentence' END AS form FROM conversations")
def p19(spark, sf):
    task = F.when(F.col("role") == "system", "video_captioning").otherwise("video_qa")
    kind = F.when(F.col("role") == "user", "entity_existence").otherwise("attribute_value")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.answer_form(task, kind).alias("form"))


@query("p20_complete_sentence", "SELECT conv_id, turn, regexp_matches(trim(text), '^\\S+\\s+.+[.!?]\\z') AS whole FROM conversations")
def p20(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.complete_sentence(F.col("text")).alias("whole"))


@query("p27_name_parts", "SELECT url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS number FROM pages")
def p27(spark, sf):
    return table(spark, sf, "pages").select("url", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)[^0-9]*$", 1).alias("number"))


@query("f1_template_index", "SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || source), 1, 16))::UBIGINT % 7 AS INT) AS template FROM documents")
def f1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.template_index(F.concat_ws("|", F.col("doc_id").cast("string"), "source"), 7).alias("template"))


@query("f2_fill_template", "SELECT doc_id, 'Is ' || source || ' in ' || lang || ' from ' || source || '?' AS question FROM documents")
def f2(spark, sf):
    filled = T.fill_template(F.lit("Is {source} in {lang} from {source}?"), {"source": F.col("source"), "lang": F.col("lang")})
    return table(spark, sf, "documents").select("doc_id", filled.alias("question"))


@query(
    "f3_referential_phrase",
    """WITH p AS (SELECT p_partkey, trim(replace(p_name, '_', ' ')) AS x FROM part)
       SELECT p_partkey, CASE WHEN x = '' OR regexp_matches(x, '^[A-Z0-9]') OR lower(split_part(x, ' ', 1)) IN ('a', 'an', 'the', 'this', 'that', 'these', 'those', 'his', 'her', 'its', 'their', 'our', 'my', 'your', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'he', 'she', 'it', 'they', 'we', 'you', 'i', 'him', 'them') THEN x ELSE 'the ' || x END AS phrase FROM p""",
)
def f3(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.referential_phrase(F.col("p_name")).alias("phrase"))


@query("f4_safe_id", "SELECT page_id, regexp_replace(regexp_replace(url, '[^0-9A-Za-z_]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe FROM pages")
def f4(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_id(F.col("url")).alias("safe"))


@query("f5_object_name", "SELECT doc_id, 'media/' || substr(sha256(source), 1, 2) || '/' || sha256(source) || '/' || source || '_' || lang || '.mov' AS name FROM documents")
def f5(spark, sf):
    name = T.object_name("/media/", F.concat(F.lit("._"), "source", F.lit("  "), "lang"), F.sha2("source", 256), F.concat("source", F.lit(".MOV")))
    return table(spark, sf, "documents").select("doc_id", name.alias("name"))


@query("f13_mime_type", "SELECT doc_id, CASE lang WHEN 'en' THEN 'video/mp4' WHEN 'de' THEN 'video/webm' END AS mime FROM documents")
def f13(spark, sf):
    suffix = F.when(F.col("lang") == "en", ".MP4").when(F.col("lang") == "de", ".webm").otherwise(".txt")
    return table(spark, sf, "documents").select("doc_id", T.mime_type(F.concat("source", suffix)).alias("mime"))


@query(
    "f6_redaction",
    """WITH x AS (SELECT doc_id, 'Authorization: Bearer ' || source || doc_id || ' AIza' || doc_id || ' x-goog-api-key=' || lang || '; ok' AS t FROM documents)
       SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, 'AQ\\.[A-Za-z0-9_-]+', '[REDACTED]', 'g'), 'AIza[A-Za-z0-9_-]+', '[REDACTED]', 'g'), '(x-goog-api-key\\s*[:=]\\s*)[^\\s,;"'']+', '\\1[REDACTED]', 'gi'), '(authorization\\s*[:=]\\s*bearer\\s+)[^\\s,;"'']+', '\\1[REDACTED]', 'gi') AS clean FROM x""",
)
def f6(spark, sf):
    said = F.concat(F.lit("Authorization: Bearer "), "source", F.col("doc_id").cast("string"), F.lit(" AIza"), F.col("doc_id").cast("string"), F.lit(" x-goog-api-key="), "lang", F.lit("; ok"))
    return table(spark, sf, "documents").select("doc_id", T.redact(said).alias("clean"))


@query("f10_time_difference", "SELECT l_orderkey, l_linenumber, date_diff('microsecond', o_orderdate, l_shipdate) / 1e6 AS seconds FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def f10(spark, sf):
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    return joined.select("l_orderkey", "l_linenumber", (F.expr("timestampdiff(MICROSECOND, o_orderdate, l_shipdate)") / 1e6).alias("seconds"))


@query("f12_uris", "SELECT doc_id, 'memory://' || source || '/' || lang || '/' || doc_id AS uri FROM documents")
def f12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.scheme_uri("memory", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("uri"))


@query("f15_path_parts", "WITH p AS (SELECT page_id, regexp_replace(url, '^https?:/', '') || '/index.html' AS p FROM pages) SELECT page_id, regexp_extract(p, '^(.*)/[^/]*$', 1) AS parent, regexp_replace(regexp_extract(p, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, '.html' AS suffix FROM p")
def f15(spark, sf):
    path = F.concat(F.regexp_replace("url", "^https?:/", ""), F.lit("/index.html"))
    return table(spark, sf, "pages").withColumn("p", path).select("page_id", *[c.alias(k) for k, c in T.path_parts(F.col("p")).items()])


@query("f16_access_failure", "SELECT event_id, event_type = 'error' OR (event_type = 'view' AND contains(lower(props), 'project')) AS failure FROM events")
def f16(spark, sf):
    status = F.when(F.col("event_type") == "error", 401).when(F.col("event_type") == "view", 403).otherwise(500)
    return table(spark, sf, "events").select("event_id", T.access_failure(status, F.when(F.contains("props", F.lit("project")), "project").otherwise("")).alias("failure"))


@query(
    "w11_hash_steps",
    """WITH h AS (SELECT conv_id, turn, ('0x' || substr(sha256(text), 1, 16))::UBIGINT AS h FROM conversations WHERE text IS NOT NULL),
            s AS (SELECT conv_id, bit_count(xor(h, lag(h) OVER (PARTITION BY conv_id ORDER BY turn))) AS d FROM h)
       SELECT conv_id, CAST(coalesce(max(d), 0) AS INT) AS step FROM s GROUP BY 1""",
)
def w11(spark, sf):
    rows = table(spark, sf, "conversations").where("text is not null").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.substring(F.sha2("text", 256), 1, 16).alias("h")))), lambda x: x["h"]).alias("hs"))
    return rows.select("conv_id", T.greatest_step(F.col("hs")).alias("step"))


@query(
    "w13_first_fact_per_leaf",
    f"""WITH f AS (SELECT user_id AS video, event_type AS leaf, event_id, CAST({SECONDS} AS DOUBLE) AS s FROM events),
             o AS (SELECT user_id AS video, event_type AS leaf, CAST(min({SECONDS}) AS DOUBLE) + 86400 * 5 AS s, CAST(min({SECONDS}) AS DOUBLE) + 86400 * 9 AS e FROM events GROUP BY 1, 2)
        SELECT video, leaf, min(event_id) AS event_id FROM f JOIN o USING (video, leaf) WHERE f.s <= o.e AND f.s + 60 >= o.s GROUP BY 1, 2""",
)
def w13(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("video"), F.col("event_type").alias("leaf"), "event_id", seconds().alias("start_sec")).withColumn("end_sec", F.col("start_sec") + 60)
    first = rows.groupBy("video", "leaf").agg(F.min("start_sec").alias("m"))
    opportunities = first.select("video", "leaf", F.lit(True).alias("constructible"), F.array(F.struct((F.col("m") + 86400 * 5).alias("start_sec"), (F.col("m") + 86400 * 9).alias("end_sec"))).alias("intervals"))
    return facts.first_fact_per_leaf(rows, opportunities, "video", "event_id").select("video", "leaf", "event_id")


@query("n1_flatten_json", """WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS path FROM events) SELECT event_id, path, CAST(json_extract(props, '$."' || path || '"') AS VARCHAR) AS value FROM k""")
def n1(spark, sf):
    return facts.flatten_json(table(spark, sf, "events"), "event_id", "props")


@query(
    "n2_fact_diff",
    """SELECT o_orderkey, CAST(CASE WHEN o_orderstatus <> 'O' OR o_totalprice > 100000 THEN 1 ELSE 0 END AS INT) AS changed_facts, CAST((o_orderstatus <> 'O')::INT + (o_totalprice > 100000)::INT AS INT) AS changed_slots,
              concat_ws(',', CASE WHEN o_totalprice > 100000 THEN 'large' END, CASE WHEN o_orderstatus <> 'O' THEN 'status' END) AS paths FROM orders""",
)
def n2(spark, sf):
    pair = lambda status, large: F.array(F.create_map(F.lit("status"), status, F.lit("large"), large))
    rows = table(spark, sf, "orders").select("o_orderkey", pair(F.col("o_orderstatus"), (F.col("o_totalprice") > 100000).cast("string")).alias("b"), pair(F.lit("O"), F.lit("false")).alias("a"))
    return facts.fact_diff(rows, "b", "a").select("o_orderkey", "changed_facts", "changed_slots", F.array_join("changed_paths", ",").alias("paths"))


@query("n4_slot_replacement", "SELECT o_orderkey, o_orderpriority AS priority, 'X' AS status FROM orders")
def n4(spark, sf):
    fact = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority")
    out = table(spark, sf, "orders").select("o_orderkey", facts.replace_slot(fact, F.lit("status"), F.lit("X")).alias("m"))
    return out.select("o_orderkey", F.col("m")["priority"].alias("priority"), F.col("m")["status"].alias("status"))


@query(
    "n6_opportunities",
    f"""WITH v AS (SELECT DISTINCT l_orderkey FROM lineitem), e AS (SELECT l_orderkey, leaf FROM v, unnest({NAMES}) AS x(leaf)),
             r AS (SELECT l_orderkey, {NAMES}[l_linenumber] AS leaf, l_discount > 0.03 AND l_returnflag <> 'R' AS ok FROM lineitem WHERE l_linenumber <= 8 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_discount, l_returnflag, l_quantity) = 1)
        SELECT l_orderkey AS video, leaf, coalesce(ok, false) AS constructible, CASE WHEN coalesce(ok, false) THEN 'seen' ELSE '' END AS anchor FROM e LEFT JOIN r USING (l_orderkey, leaf)""",
)
def n6(spark, sf):
    from ..operators.curation import keep_first

    names = F.array(*[F.lit(x[1]) for x in facts.LEAVES])
    lines = keep_first(table(spark, sf, "lineitem").where("l_linenumber <= 8"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_discount", "l_returnflag", "l_quantity"])
    interval = F.array(F.struct(F.lit(0.0).alias("start_sec"), F.col("l_quantity").alias("end_sec")))
    rows = lines.select(F.col("l_orderkey").alias("video"), F.element_at(names, F.col("l_linenumber")).alias("leaf"), F.when(F.col("l_discount") > 0.03, interval).alias("intervals"), F.when(F.col("l_returnflag") != "R", "seen").otherwise(" ").alias("anchor"))
    return facts.normalize_opportunities(rows, "video").select("video", "leaf", "constructible", "anchor")


@query("n7_explode_collect", "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS flags FROM lineitem GROUP BY 1")
def n7(spark, sf):
    listed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("x"))
    return listed.select("l_orderkey", F.array_join(F.col("x.l_returnflag"), "").alias("flags"))


@query(
    "n9_canonical_digest",
    """WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events), p AS (SELECT event_id, '"' || k || '":' || CAST(json_extract(props, '$."' || k || '"') AS VARCHAR) AS p, k FROM k)
       SELECT event_id, sha256('{' || string_agg(p, ',' ORDER BY k) || '}') AS digest FROM p GROUP BY event_id""",
)
def n9(spark, sf):
    return table(spark, sf, "events").select("event_id", F.sha2(facts.canonical_json(F.col("props")), 256).alias("digest"))


@query("n11_map_of_results", "SELECT o_custkey, o_orderstatus AS key, count(*) AS value FROM orders GROUP BY 1, 2")
def n11(spark, sf):
    maps = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return maps.select("o_custkey", F.explode("m").alias("key", "value"))


@query("p23_hidden_keys", "SELECT event_id, list_filter(['device', 'k'], lambda x: list_contains(json_keys(props), x)) AS found FROM events")
def p23(spark, sf):
    return facts.hidden_keys(table(spark, sf, "events"), "event_id", "props", ["device", "k"])
