from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import facts


def test_overlap_rejects_inverted_and_null(spark):
    rows = [(0.0, 1.0, 1.0, 2.0, True), (0.0, 1.0, 1.1, 2.0, False), (2.0, 1.0, 0.0, 3.0, False), (None, 1.0, 0.0, 3.0, False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, want boolean")
    assert not df.where(facts.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("want")).collect()


def test_monitor_chain_order(spark):
    report = "struct<agent_role:string,accepted:boolean,answer_verdict:string,counterfactual_verdict:string,natural_answer_matches_source_fact:boolean,leaf_boundary_correct:boolean,counterfactual_targets_planned_leaf:boolean,single_target_slot:boolean,additional_error_count:long,answer_evidence_interval:struct<start_sec:double,end_sec:double>,evidence_summary:string,shares_observations:boolean>"
    good = ("m", True, "supported", "contradicted", True, True, True, True, 0, (0.0, 2.0), "seen", None)
    rows = [(good, (1.0, 3.0)), (("m", False, *good[2:]), (1.0, 3.0)), (good, (5.0, 6.0)), ((*good[:10], " ", False), (1.0, 3.0)), (("x", *good[1:]), (1.0, 3.0)), ((*good[:11], True), (1.0, 3.0))]
    df = spark.createDataFrame(rows, f"r {report}, s struct<start_sec:double,end_sec:double>")
    got = [x[0] for x in df.select(facts.monitor_rejection(F.col("r"), F.col("s"), "m")).collect()]
    assert got == [None, "accepted", "evidence interval overlap", "evidence summary", "agent role", "independent observations"]


def test_fact_diff(spark):
    rows = [(1, [{"a": "1", "b": "2"}], [{"a": "1", "b": "3"}]), (2, [{"a": "1"}], [{"b": "1"}]), (3, [{"a": "1"}], []), (4, [{"a": None}], [{"a": None}])]
    got = {r.id: r for r in facts.fact_diff(spark.createDataFrame(rows, "id long, b array<map<string,string>>, a array<map<string,string>>"), "b", "a").collect()}
    assert (got[1].changed_facts, got[1].changed_slots, got[1].changed_paths) == (1, 1, ["b"])
    assert got[2].problem == "slot structure differs" and got[3].problem == "fact counts differ"
    assert got[4].changed_slots == 0


def test_opportunities_and_first_facts(spark):
    rows = spark.createDataFrame([("v", "EntityQuantity", [(0.0, 5.0)], "x"), ("v", "EntityCategory", [(0.0, 5.0)], " "), ("v", "CameraPredicate", [], "y")], "video string, leaf string, intervals array<struct<start_sec:double,end_sec:double>>, anchor string")
    got = facts.normalize_opportunities(rows, "video").cache()
    assert got.count() == 8 and [r.leaf for r in got.where("constructible").collect()] == ["EntityQuantity"]
    scoped = spark.createDataFrame([("v", "EntityQuantity", 1, 6.0, 7.0), ("v", "EntityQuantity", 2, 5.0, 9.0), ("v", "EntityQuantity", 3, 1.0, 2.0)], "video string, leaf string, n long, start_sec double, end_sec double")
    assert [r.n for r in facts.first_fact_per_leaf(scoped, got, "video", "n").collect()] == [2]


def test_json_functions(spark):
    rows = [(1, '{"b": [1, {"c": null}], "a": {}}'), (2, None), (3, '[{"k": {"z": 1}}]'), (4, "{broken"), (5, "7"), (6, "{}")]
    df = spark.createDataFrame(rows, "i long, j string")
    flat = sorted(map(tuple, facts.flatten_json(df, "i", "j").collect()))
    assert flat == [(1, "b[0]", "1"), (1, "b[1].c", "null"), (3, "[0].k.z", "1"), (5, "", "7")]
    assert [r[0] for r in df.orderBy("i").select(facts.canonical_json(F.col("j"))).collect()] == ['{"a":{},"b":[1,{"c":null}]}', None, '[{"k":{"z":1}}]', None, "7", "{}"]
    assert {r.i: r.found for r in facts.hidden_keys(df, "i", "j", ["z", "c", "q"]).collect()} == {1: ["c"], 2: [], 3: ["z"], 4: [], 5: [], 6: []}
    assert facts.flatten_json(df.limit(0), "i", "j").count() == 0


def test_memory_categories_search_named_containers(spark):
    rows = [(1, '{"leaf_label": "A", "facts": [{"planned_leaf_label": "B", "note": {"leaf_label": "no"}}, {"leaf_label": "A"}]}'), (2, '{"note": {"leaf_label": "no"}}'), (3, '[{"opportunities": [[{"leaf_label": "C"}]]}]'), (4, None), (5, '{"leaf_label": null}')]
    got = facts.memory_categories(spark.createDataFrame(rows, "i long, j string"), "i", "j")
    assert {r.i: sorted(r.categories) for r in got.collect()} == {1: ["A", "B"], 2: ["global"], 3: ["C"], 4: ["global"], 5: ["global"]}


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(T.referential_phrase(F.lit(x))) for x in ("red_car", "the dog", "Paris sky", "2 cats", "", "she")] == ["the red car", "the dog", "Paris sky", "2 cats", "", "she"]
    assert one(T.safe_id(F.lit("__a b/c__"))) == "a_b_c"
    assert one(T.safe_component(F.lit("._"))) == "video" and one(T.safe_component(F.lit(".a-b c."))) == "a-b_c"
    assert one(T.redact(F.lit("Authorization: Bearer abc, AIzaXYZ"))) == "Authorization: Bearer [REDACTED], [REDACTED]"
    assert one(T.hamming64(F.lit("ffffffffffffffff"), F.lit("0000000000000001"))) == 63
    assert one(T.mime_type(F.lit("a/b.MP4"))) == "video/mp4" and one(T.mime_type(F.lit("a/b.xyz"))) is None
    form = F.lit("polar_explained_sentence")
    said = [one(T.alignment_problem(form, F.lit(q), F.lit(a), F.lit(e))) for q, a, e in (("Is it red?", "Yes, it is red.", True), ("What?", "Yes, it is red.", True), ("Is it?", "Yes.", True), ("Is it?", "no, it is not.", True))]
    assert said == [None, "question is not polar", "answer is not an explained yes or no", "polarity disagrees"]


def test_all_reasons_and_gate(spark):
    assert spark.range(1).select(facts.all_reasons(("a", F.lit(False)), ("b", F.lit(True)), ("c", F.lit(None).cast("boolean")))).first()[0] == ["a", "c"]
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    gate = facts.evidence_gate(words("a"), words("b"), words("a"), words("a"), F.lit("consistent"))
    assert spark.range(1).select(gate).first()[0] == "supporting modalities must be allowed"


def test_overlaps_of_a_hot_key_by_pieces_equal_the_join_by_key(spark):
    import random

    from tessera.operators import facts

    rng = random.Random(5)

    def rows(n):
        for i in range(n):
            start = rng.choice([rng.randrange(1000), rng.random() * 1000, 500.0, None])
            length = rng.choice([0, rng.random(), 7, 300, -1, float("inf"), None])
            yield i, rng.choice(["hot", "hot", "hot", "a", None]), start and float(start), None if start is None or length is None else float(start + length)

    left = spark.createDataFrame(list(rows(300)), "i long, k string, s double, e double")
    right = spark.createDataFrame(list(rows(250)), "j long, k string, s2 double, e2 double")
    want = sorted((r.i, r.j) for r in facts.overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), most=10**6).collect())
    for most in (0, 100):
        got = facts.overlap_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), most=most)
        assert got.columns == ["i", "k", "s", "e", "j", "s2", "e2"]
        assert sorted((r.i, r.j) for r in got.collect()) == want and len(want) > 1000
    one = spark.createDataFrame([(1, "k", 5.0, 5.0)], "i long, k string, s double, e double")
    assert facts.overlap_join(one, one.toDF("j", "k", "s2", "e2"), ["k"], ("s", "e"), ("s2", "e2"), most=0).count() == 1


def test_digest_of_a_table_knows_every_cell_and_no_partitioning(spark):
    from tessera.operators.checks import table_digest

    rows = [(i, f"t{i}" if i % 5 else None) for i in range(5000)]
    make = lambda r, names="i long, t string": spark.createDataFrame(r, names)
    digest = table_digest(make(rows))
    assert digest == table_digest(make(rows[::-1]).repartition(13)) == table_digest(make(rows).select("t", "i"))
    others = [make(rows[:-1]), make([*rows, rows[0]]), make([(0, "")] + rows[1:]), make([(0, "t1")] + rows[1:]), make(rows, "i long, u string"), make(rows, "i int, t string"), make([]), make([], "i int, t string")]
    assert len({digest, *map(table_digest, others)}) == 1 + len(others)


def same_as_sql(spark, path, name, tables):
    """Rows of a query over `tables` (SQL by name), once its SQL in DuckDB gives the same."""
    import duckdb

    from tessera.plans import catalog

    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{path}/{table}.parquet'")
        con.sql(f"CREATE OR REPLACE VIEW {table} AS FROM '{path}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, str(path))
    want = con.sql(catalog.ORACLES[name])
    at = [want.columns.index(c) for c in got.columns]
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
    return rows


def events_sql(*rows):
    """`events` of (event_id, seconds, user_id, event_type)."""
    values = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-01' + to_microseconds({round(s * 1e6)}), {u}::BIGINT, '{t}')" for i, s, u, t in rows)
    return f"SELECT * FROM (VALUES {values}) AS e(event_id, ts, user_id, event_type)"


def test_overlaps_at_parts_of_a_second_equal_sql(spark, tmp_path):
    views = [(0, 100.4, 1, "view"), (10, 100.5, 2, "view"), (20, 101.5, 3, "view"), (30, 100.6, 4, "view")]
    clicks = [(1 + 10 * u, at + 7200, u + 1, "click") for u, at in enumerate((100.6, 100.7, 102.5, 101.4))]
    assert same_as_sql(spark, tmp_path, "j8_overlap_join", {"events": events_sql(*views, *clicks)}) == [(3, 21, 20), (4, 31, 30)]


def test_first_facts_at_parts_of_a_second_equal_sql(spark, tmp_path):
    opens, closes = 5 * 86400, 9 * 86400
    rows = [(0, 10.2, 1, "view"), (1, 10.2 + opens - 60.6, 1, "view"), (2, 10.4 + opens - 60, 1, "view"), (10, 10.2, 2, "view"), (11, 10.6 + closes, 2, "view"), (20, 10.5, 3, "view"), (21, 11.5 + closes, 3, "view"), (30, 10.6, 4, "view"), (31, 11.3 + closes, 4, "view")]
    assert same_as_sql(spark, tmp_path, "w13_first_fact_per_leaf", {"events": events_sql(*rows)}) == [(1, "view", 1), (4, "view", 31)]


def test_forms_of_answers_on_odd_texts_equal_sql(spark, tmp_path):
    starts = ["Doó", "do", "Do x.", "Doñe", "was_", "waſ", "waſ x", "Waſx", "ıs it", "Is\u0301", "could\u0430", "yes", "Yes,", "yeſ, a b.", "yeſ", "yesé", "no\u0301", "NO", "Noé, a b.", "maybe", ""]
    ends = ["", " a", ", it is so.", ",\x0bit is.", ", it\x0bis.", ", it is\r.", ", it is\u0085.", ", it is\u2028so.", ", it is\nso.", ",\nit is.", "\u00a0it is.", ", 😀 is!", ", it is.\n"]
    texts = [b + s + e + b for s in starts for e in ends for b in ("", " ", "\u00a0", "\u3000 ", "\t", "\u200b")] + [None]
    rows = [(i, k, role, t) for i, t in enumerate(texts) for k, role in enumerate(("user", "assistant", "system", None))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/rows")
    odd = {"conversations": f"FROM '{tmp_path}/rows/*.parquet'"}
    assert {r[2] for r in same_as_sql(spark, tmp_path, "p18_answer_alignment", odd)} == {None, "question is not polar", "answer is not an explained yes or no", "answer begins with yes or no"}
    assert {r[2] for r in same_as_sql(spark, tmp_path, "p20_complete_sentence", odd)} == {None, True, False}
