"""Facts, their opportunities, reports and pairs: joins on intervals, ordered gates, diffs of slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ordering import cut

from .ordering import cut

# The eight leaves, their kinds of fact, slots, parents and operators.
LEAVES = [
    ("Entity", "EntityExistence", "entity_existence", "existence", "toggle_entity_existence"),
    ("Entity", "EntityCategory", "entity_category", "category", "replace_entity_category"),
    ("Entity", "EntityQuantity", "entity_quantity", "count", "change_entity_count"),
    ("Attribute", "AttributeValue", "attribute_value", "attribute_value", "replace_attribute_value"),
    ("Relation", "StaticRelation", "static_relation", "relation_predicate", "invert_static_relation"),
    ("Action", "ActionPredicate", "action_predicate", "predicate", "replace_action_predicate"),
    ("Event", "TemporalRelation", "temporal_relation", "order", "reverse_temporal_order"),
    ("Camera", "CameraPredicate", "camera_predicate", "camera_predicate", "replace_camera_predicate"),
]


def leaves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEAVES, "parent string, leaf string, fact_kind string, slot string, operator_id string")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals that meet; inverted and null ones meet nothing."""
    proper = (a_end >= a_start) & (b_end >= b_start)
    return F.coalesce(proper & (a_start <= b_end) & (a_end >= b_start), F.lit(False))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], *, most: int = 10_000) -> DataFrame:
    """Rows of equal keys whose closed intervals meet; null keys meet nothing.

    Keys with up to `most` rows on each side are joined by key, with the interval as condition. For the others, whose rows would all
    meet in one task, time is cut by a grid: see `_grid_join`. Starts and ends are numbers.
    """
    hot = None
    for side in (left, right):
        many = side.groupBy(*keys).count().where(F.col("count") > most).select(*keys)
        hot = many if hot is None else hot.unionByName(many)
    hot = cut(hot.distinct())
    if hot.isEmpty():
        return _key_join(left, right, keys, a, b)
    parts = {how: [side.join(hot, keys, how).select(*side.columns) for side in (left, right)] for how in ("left_anti", "left_semi")}
    return _key_join(*parts["left_anti"], keys, a, b).unionByName(_grid_join(*parts["left_semi"], keys, a, b))


def _key_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], further: Column | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    on = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in (*keys, *also)]
    met = overlaps(F.col(f"l.{a[0]}"), F.col(f"l.{a[1]}"), F.col(f"r.{b[0]}"), F.col(f"r.{b[1]}"))
    met = met if further is None else met & further
    joined = left.alias("l").join(right.alias("r"), reduce(lambda x, y: x & y, on) & met)
    shown = [F.col(f"l.{c}") for c in left.columns if not c.startswith("_grid_")]
    return joined.select(*shown, *[F.col(f"r.{c}") for c in right.columns if c not in keys and not c.startswith("_grid_")])


def _grid_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """The same rows by pieces: an interval lies in at most a few pieces of a grid as wide as itself, and the piece in which the later one starts owns a pair.

    Grids are 1, 4, 16, ... times 1/65536 of the whole time wide; a pair is looked for in the wider of its two intervals' own
    grids, so an interval goes to its own grid and the wider ones that are in use, nine at most.
    """
    ends = left.select(*[F.col(c).cast("double").alias(n) for c, n in zip(a, "se")]).unionByName(right.select(*[F.col(c).cast("double").alias(n) for c, n in zip(b, "se")]))
    some = ends.select(F.explode(F.array("s", "e")).alias("x")).where(F.abs("x") < float("inf"))
    low, high = some.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return _key_join(left, right, keys, a, b)
    width = max((high - low) / 4**8, 1e-300)

    def own(side: DataFrame, columns: tuple[str, str]) -> DataFrame:
        start, end = (F.greatest(F.least(F.col(c).cast("double"), F.lit(high)), F.lit(low)) for c in columns)
        level = F.coalesce(*[F.when(F.col("_grid_e") - F.col("_grid_s") <= width * 4**k, k) for k in range(9)], F.lit(9))
        return side.where(F.col(columns[1]) >= F.col(columns[0])).withColumns({"_grid_s": start, "_grid_e": end}).withColumn("_grid_own", level)

    sides = [own(left, a), own(right, b)]
    used = sorted({r[0] for side in sides for r in side.select("_grid_own").distinct().collect()})  # ten at most
    levels = F.array(*[F.lit(k) for k in used]).cast("array<int>")
    wide = lambda: F.lit(width) * F.pow(F.lit(4.0), F.col("_grid_level"))
    pieces = []
    for side in sides:
        leveled = side.withColumn("_grid_level", F.explode(F.filter(levels, lambda k: k >= F.col("_grid_own"))))
        place = lambda c: F.floor((F.col(c) - low) / wide())
        pieces.append(leveled.withColumn("_grid_piece", F.explode(F.sequence(place("_grid_s"), place("_grid_e")))))
    later = F.floor((F.greatest("l._grid_s", "r._grid_s") - low) / (F.lit(width) * F.pow(F.lit(4.0), F.col("l._grid_level"))))
    owned = (F.greatest("l._grid_own", "r._grid_own") == F.col("l._grid_level")) & (later == F.col("l._grid_piece"))
    return _key_join(*pieces, keys, a, b, owned, ("_grid_level", "_grid_piece"))


def repair_nested(value: Column, *, drop: list[str] = (), put: dict[str, Column] | None = None) -> Column:
    """A struct without the fields of `drop`, and with those of `put` set to new values: what an older layout lacks or must not have.

    A null struct stays null. Dotted names reach into structs below; a field of `drop` that is not there is no error.
    """
    out = value.dropFields(*drop) if drop else value
    for name, column in (put or {}).items():
        out = out.withField(name, column)
    return out


def first_reason(*checks: tuple[str, Column]) -> Column:
    """Name of the first check that fails (false or null), or null: a chain in order."""
    chain = F.when(~F.coalesce(checks[0][1], F.lit(False)), checks[0][0])
    for name, passed in checks[1:]:
        chain = chain.when(~F.coalesce(passed, F.lit(False)), name)
    return chain


def all_reasons(*checks: tuple[str, Column]) -> Column:
    """Names of all checks that fail, in order, as an array."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(passed, F.lit(False)), F.lit(name)) for name, passed in checks]))


def eligibility(facts: DataFrame) -> DataFrame:
    """`leaf_label`, `eligible` and `reason` for facts with fact_kind, accepted, evaluable, alternatives, verdict; kinds off the list go."""
    kinds = leaves(facts.sparkSession).select("fact_kind", F.col("leaf").alias("leaf_label"))
    failed = all_reasons(
        ("fact_reflection_missing", F.col("accepted")),
        ("dependency_not_evaluable", F.col("evaluable")),
        ("no_grounded_counterfactual_alternative", F.col("alternatives") >= 1),
        ("source_fact_not_supported", F.coalesce("verdict", F.lit("supported")) == "supported"),
    )
    out = facts.join(F.broadcast(kinds), "fact_kind").withColumn("_r", failed)  # eight rows
    return out.withColumn("eligible", F.size("_r") == 0).withColumn("reason", F.when(F.size("_r") == 0, "eligible").otherwise(F.array_join("_r", ";"))).drop("_r")


def monitor_rejection(report: Column, scope: Column, role: str) -> Column:
    """Why a monitor's report (a struct) does not pass, the first of eleven checks in their order, or null."""
    interval = report["answer_evidence_interval"]
    return first_reason(
        ("agent role", report["agent_role"] == role),
        ("accepted", report["accepted"]),
        ("answer verdict", report["answer_verdict"] == "supported"),
        ("counterfactual verdict", report["counterfactual_verdict"] == "contradicted"),
        ("natural answer grounding", report["natural_answer_matches_source_fact"]),
        ("leaf boundary", report["leaf_boundary_correct"]),
        ("planned leaf target", report["counterfactual_targets_planned_leaf"]),
        ("single target slot", report["single_target_slot"]),
        ("additional error count", F.coalesce(report["additional_error_count"], F.lit(0)) == 0),
        ("evidence interval overlap", overlaps(interval["start_sec"], interval["end_sec"], scope["start_sec"], scope["end_sec"])),
        ("evidence summary", F.trim(F.coalesce(report["evidence_summary"], F.lit(""))) != ""),
        ("independent observations", ~F.coalesce(report["shares_observations"], F.lit(False))),
    )


def evidence_gate(required: Column, supporting: Column, allowed: Column, registered: Column, status: Column) -> Column:
    """First modality rule that is broken, or null."""
    subset = lambda a, b: F.size(F.array_except(a, b)) == 0
    return first_reason(
        ("required modalities are not registered", subset(required, registered)),
        ("required modalities must be allowed", subset(required, allowed)),
        ("supporting modalities must be allowed", subset(supporting, allowed)),
        ("cross-modal evidence is unresolved", ~status.isin("conflicting", "unreliable", "unknown")),
    )


def windows_inside(windows: Column, duration: Column) -> Column:
    """All windows (start_ms, end_ms) with 0 <= start < end <= duration."""
    return F.forall(windows, lambda w: (w["start_ms"] >= 0) & (w["end_ms"] > w["start_ms"]) & (w["end_ms"] <= duration))


def accepted_once(facts: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """Facts with exactly one report, and that accepted."""
    one = reports.groupBy(*keys).agg(F.count("*").alias("_n"), F.bool_and("accepted").alias("_all")).where("_n = 1 and _all")
    return facts.join(one.select(*keys), keys, "left_semi")


def taxonomy_mismatches(taxonomy: DataFrame, plan: DataFrame, operators: DataFrame) -> DataFrame:
    """Leaves on which taxonomy, plan and operators (each leaf, fact_kind, slot) do not agree."""
    named = lambda df, p: df.select("leaf", F.struct("fact_kind", "slot").alias(p))
    both = named(taxonomy, "a").join(named(plan, "b"), "leaf", "full").join(named(operators, "c"), "leaf", "full")
    return both.where(~(F.col("a").eqNullSafe(F.col("b")) & F.col("b").eqNullSafe(F.col("c")))).select("leaf")


def entries(value: Column) -> Column:
    """A map's entries as a sorted array, which can be compared."""
    return F.array_sort(F.map_entries(value))


def changed_paths(before: Column, after: Column) -> Column:
    """Sorted keys at which two maps of one set of keys differ; null if their keys differ."""
    same = F.array_sort(F.map_keys(before)) == F.array_sort(F.map_keys(after))
    return F.when(same, F.array_sort(F.filter(F.map_keys(before), lambda k: ~before[k].eqNullSafe(after[k]))))


def fact_diff(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """changed_facts, changed_slots and the paths of arrays of maps; problem if counts or structures differ."""
    zipped = F.transform(F.arrays_zip(F.col(before).alias("b"), F.col(after).alias("a")), lambda z: changed_paths(z["b"], z["a"]))
    counted = F.size(before) == F.size(after)
    out = pairs.withColumn("_p", F.when(counted, zipped))
    problem = F.when(~counted, "fact counts differ").when(F.exists("_p", lambda p: p.isNull()), "slot structure differs")
    out = out.withColumn("problem", problem).withColumn("_p", F.when(F.col("problem").isNull(), F.col("_p")))
    return out.withColumn("changed_facts", F.size(F.filter("_p", lambda p: F.size(p) > 0))).withColumn("changed_slots", F.size(F.flatten("_p"))).withColumn("changed_paths", F.flatten("_p")).drop("_p")


def single_error_failures(**values: Column) -> Column:
    """Names of all broken single-error rules."""
    zero = lambda name: (name, F.coalesce(values.get(name, F.lit(0)), F.lit(0)) == 0)
    return all_reasons(
        ("changed_atomic_fact_count", values["changed_atomic_fact_count"] == 1),
        ("changed_slot_count", values["changed_slot_count"] == 1),
        zero("supported_contradicted_claim_count"),
        ("counterfactual_contradicted_claim_count", values["counterfactual_contradicted_claim_count"] == 1),
        zero("additional_error_count"),
        zero("blocked_dependency_count"),
        zero("unresolved_modality_conflict_count"),
        ("true_elsewhere", ~F.coalesce(values.get("true_elsewhere", F.lit(False)), F.lit(False))),
    )


def replace_slot(fact: Column, slot: Column, value: Column) -> Column:
    """The map with one key's value replaced."""
    return F.transform_values(fact, lambda k, v: F.when(k == slot, value).otherwise(v))


def normalize_opportunities(rows: DataFrame, video: str) -> DataFrame:
    """One row for each video and leaf; without an interval and an anchor a leaf is not constructible and both are emptied."""
    every = rows.select(video).distinct().join(leaves(rows.sparkSession).select("leaf"))  # eight a video
    both = every.join(rows, [video, "leaf"], "left")
    usable = F.coalesce((F.size("intervals") > 0) & (F.trim("anchor") != ""), F.lit(False))
    empty = F.array().cast("array<struct<start_sec:double,end_sec:double>>")
    return both.select(
        video, "leaf", usable.alias("constructible"), F.when(usable, F.col("intervals")).otherwise(empty).alias("intervals"), F.when(usable, F.col("anchor")).otherwise("").alias("anchor")
    )


def first_fact_per_leaf(facts: DataFrame, opportunities: DataFrame, video: str, ordinal: str) -> DataFrame:
    """For each video and leaf the first fact, by ordinal, whose scope meets one of the leaf's intervals."""
    spans = opportunities.where("constructible").select(video, "leaf", F.explode("intervals").alias("i")).select(video, "leaf", F.col("i.start_sec").alias("o_start"), F.col("i.end_sec").alias("o_end"))
    met = overlap_join(facts, spans, [video, "leaf"], ("start_sec", "end_sec"), ("o_start", "o_end")).drop("o_start", "o_end")
    rank = F.row_number().over(Window.partitionBy(video, "leaf").orderBy(ordinal))
    return met.withColumn("_k", rank).where("_k = 1").drop("_k")


def json_nodes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, path (`a.b[0]`, empty for the whole), name (null in arrays), value: every node of each JSON text.

    The values are variants, so the walk stays in the JVM; each level of nesting is one round.
    Null and malformed texts have no nodes. `key` tells the rows apart.
    """
    below = """
        SELECT n.id, CASE WHEN e.key IS NULL THEN concat(n.path, '[', e.pos, ']') WHEN n.path = '' THEN e.key ELSE concat(n.path, '.', e.key) END AS path, e.key AS name, e.value
        FROM {inner} n, LATERAL variant_explode(n.value) e"""
    nothing = F.lit(None).cast("string")
    level = rows.select(F.col(key).alias("id"), F.lit("").alias("path"), nothing.alias("name"), F.try_parse_json(text).alias("value")).where("value is not null")
    nodes: DataFrame | None = None
    while True:
        level = cut(level)
        nodes = level if nodes is None else nodes.unionByName(level)
        inner = level.where(_holds_others())
        if inner.isEmpty():
            return nodes.withColumnRenamed("id", key)
        level = rows.sparkSession.sql(below, inner=inner)


def _holds_others(value: str = "value") -> Column:
    kind = F.schema_of_variant(value)
    return kind.startswith("OBJECT<") | kind.startswith("ARRAY<")


def flatten_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, path, value: the values of each JSON text that hold no others, as JSON; empty containers have no row."""
    return json_nodes(rows, key, text).where(~_holds_others()).select(key, "path", F.to_json("value").alias("value"))


def canonical_json(column: Column) -> Column:
    """JSON with sorted keys and no spaces, so that equal values have equal text and digest; null for null or malformed text.

    Objects of a variant are kept in the order of their keys.
    """
    return F.to_json(F.try_parse_json(column))


def hidden_keys(rows: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """`key`, found: which of `names` occur as keys anywhere in each JSON text, sorted; empty where none does or the text is no JSON."""
    found = json_nodes(rows, key, text).where(F.col("name").isin(names)).groupBy(key).agg(F.sort_array(F.collect_set("name")).alias("found"))
    return rows.select(key).join(found, key, "left").select(key, F.coalesce("found", F.array().cast("array<string>")).alias("found"))


# Where categories stand, and the containers that are searched for them.
CATEGORY_KEYS = ["leaf_label", "planned_leaf_label"]
CATEGORY_CONTAINERS = ["leaf_checks", "constructible_opportunities", "opportunities", "facts", "source_fact", "planned_leaf_rule"]


def memory_categories(rows: DataFrame, key: str, text: str, names: list[str] = CATEGORY_KEYS, containers: list[str] = CATEGORY_CONTAINERS) -> DataFrame:
    """`key`, categories: the distinct values of the category keys of each JSON text, at the top or in nested containers, by path; `global` where there is none."""
    nodes = json_nodes(rows, key, text)
    inside = F.forall(F.filter(F.split(F.regexp_replace("path", r"\[\d+\]", ""), r"\."), lambda x: x != ""), lambda x: x.isin(containers + names))
    value = F.coalesce(F.try_variant_get("value", "$", "string"), F.lit(""))
    found = nodes.where(F.col("name").isin(names) & inside).withColumn("category", value).where("category <> ''")
    first = found.groupBy(key, "category").agg(F.min("path").alias("path"))
    listed = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path", "category"))).alias("c")).select(key, F.col("c.category").alias("categories"))
    return rows.select(key).join(listed, key, "left").select(key, F.coalesce("categories", F.array(F.lit("global"))).alias("categories"))


def monitor_gate(reports: Column, accepted: Column, scope: Column, role: str) -> Column:
    """Why a candidate does not pass its monitor, or null: without reports it must be accepted already, else it has exactly one, which passes all checks."""
    # The messages.
    broken = monitor_rejection(F.get(reports, 0), scope, role)
    return (
        F.when(reports.isNull() & F.coalesce(accepted, F.lit(False)), F.lit(None))
        .when(reports.isNull(), "Comprehensive reliability validation is missing")
        .when(F.size(reports) != 1, "Exactly one monitor report is required")
        .when(broken == "agent role", "Monitor agent role is invalid")
        .when(broken.isNotNull(), F.concat(F.lit("Comprehensive reliability validation rejected: "), broken))
    )


def backparse_mismatches(parsed: Column, authoritative: Column) -> Column:
    """Sorted keys on which what was read back differs from what holds, those that only one side has among them."""
    keys = F.array_distinct(F.concat(F.map_keys(parsed), F.map_keys(authoritative)))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(parsed, k).eqNullSafe(F.try_element_at(authoritative, k))))


def single_slot_problem(changed_facts: Column, paths: Column, slot: Column) -> Column:
    """Why a change is not one of exactly one slot, or null."""
    return first_reason(("one fact changes", changed_facts == 1), ("one slot changes", F.size(paths) == 1), ("the slot is the planned one", F.substring_index(F.get(paths, 0), ".", -1) == slot))


def mutation_problems(mutations: DataFrame) -> DataFrame:
    """`mutations` (leaf, operator_id, slot and more) with problem: the first way in which a mutation is not its leaf's, or null."""
    known = leaves(mutations.sparkSession).select("leaf", F.col("operator_id").alias("_o"), F.col("slot").alias("_s"))
    out = mutations.join(F.broadcast(known), "leaf", "left")  # eight rows
    problem = first_reason(("leaf is unknown", F.col("_o").isNotNull()), ("operator is not the leaf's", F.col("operator_id") == F.col("_o")), ("slot is not the leaf's", F.col("slot") == F.col("_s")))
    return out.withColumn("problem", problem).drop("_o", "_s")


PUBLIC_FIELDS = ["schema_version", "pair_id", "media", "task_type", "question", "answer", "counterfactual_answer", "leaf_label", "conflict_slot"]


def public_projection(pairs: DataFrame) -> DataFrame:
    """The nine public fields and no others."""
    return pairs.select(*PUBLIC_FIELDS)


def public_input(rows: DataFrame) -> DataFrame:
    """What a run's workers may see of a selected row."""
    return rows.select("video_id", "source_path", "task_type", "sequence")


def visible_columns(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with `_`."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def exact_keys(text: Column, expected: list[str]) -> Column:
    """A JSON object has exactly the expected keys; anything else is false."""
    return F.coalesce(F.array_sort(F.json_object_keys(text)) == F.array(*[F.lit(k) for k in sorted(expected)]), F.lit(False))


def pair_problem(changed_facts: Column, changed_slots: Column, supported: Column, counterfactual: Column, errors: Column, leaf: Column, slot: Column, last_path: Column, known: Column) -> Column:
    """The first invariant that a pair breaks, or null. `known`: the slot that belongs to the leaf, null for unknown leaves."""
    tail = F.substring_index(last_path, ".", -1)
    return first_reason(
        ("one fact and one slot", (changed_facts == 1) & (changed_slots == 1)),
        ("single error", (supported == 0) & (counterfactual == 1) & (F.coalesce(errors, F.lit(0)) == 0)),
        ("leaf and slot", leaf.isNotNull() & (known == slot)),
        ("changed slot", last_path.isNull() | (tail == slot)),
    )


def realization_problem(question: Column, answer: Column, counterfactual: Column) -> Column:
    """Questions and answers are there and the answers differ."""
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return first_reason(("question", there(question)), ("answer", there(answer)), ("counterfactual answer", there(counterfactual)), ("answers differ", F.trim(answer) != F.trim(counterfactual)))


def route_evidence(grounded: Column, attempts: Column, most: int = 1) -> Column:
    """accept what is grounded, retry the rest up to `most` times, then insufficient."""
    return F.when(F.coalesce(grounded, F.lit(False)), "accept").when(F.coalesce(attempts, F.lit(0)) < most, "retry").otherwise("insufficient")


def grounded_verdict(verdict: Column, grounded: Column, interval: Column) -> Column:
    """A supported verdict without grounding or interval is contradicted."""
    return F.when((verdict == "supported") & (~F.coalesce(grounded, F.lit(False)) | interval.isNull()), "contradicted").otherwise(verdict)


def envelope(stage: str, video: Column, producers: list[str], upstream: Column, payload: Column) -> Column:
    """A stage's output with what it came from."""
    return F.struct(F.lit("stage-output").alias("schema"), F.lit(stage).alias("stage"), video.alias("video_id"), F.array(*[F.lit(p) for p in producers]).alias("producers"), upstream.alias("upstream"), payload.alias("payload"))


def envelope_problem(value: Column, stage: str) -> Column:
    return first_reason(("schema", value["schema"] == "stage-output"), ("stage", value["stage"] == stage), ("video", F.trim(value["video_id"]) != ""), ("producers", F.size(value["producers"]) > 0), ("payload", value["payload"].isNotNull()))


def candidate_problems(candidates: DataFrame, manifest: DataFrame, facts: DataFrame, eligible: DataFrame) -> DataFrame:
    """candidates (candidate_id, video_id, fact_id) with the first lookup they fail, or null."""
    mark = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    out = candidates.join(mark(manifest, ["video_id"], "_m"), "video_id", "left").join(mark(facts, ["video_id", "fact_id"], "_f"), ["video_id", "fact_id"], "left")
    out = out.join(mark(eligible, ["video_id", "fact_id"], "_e"), ["video_id", "fact_id"], "left")
    problem = first_reason(("video is not in the manifest", F.col("_m")), ("fact is unknown", F.col("_f")), ("fact is not eligible", F.col("_e")))
    return out.withColumn("problem", problem).drop("_m", "_f", "_e")
