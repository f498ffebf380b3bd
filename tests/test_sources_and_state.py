import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import telemetry
from tessera.sources import readers, sinks
from tessera.streaming import state


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('﻿{"a": 1}\n\n{"a": 2, "b": "x"}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(path), "a long, b string").collect()) == [1, 2]
    path.write_text('{"a": 1}\n[1]\nnot json\n{"a": 3}\n')
    assert sorted(r.a for r in readers.read_jsonl(spark, str(path), "a long", strict=False).collect()) == [1, 3]
    with pytest.raises(PySparkException):
        readers.read_jsonl(spark, str(path), "a long").collect()
    assert readers.read_jsonl(spark, str(tmp_path / "none"), "a long").count() == 0
    assert readers.read_json_values(spark, str(path)).count() == 3


def test_documents_csv_listing(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"videos": [{"id": "x"}, {"id": "y"}]}, indent=1))
    rows = readers.read_document_rows(spark, str(tmp_path / "d.json"), "videos", "id string").collect()
    assert [(r.ordinal, r.id) for r in sorted(rows)] == [(0, "x"), (1, "y")]
    (tmp_path / "t.csv").write_text("﻿k,v\na,1\na,2\n")
    table = readers.read_csv(spark, str(tmp_path / "t.csv"), "k string, v int")
    assert [r.v for r in readers.last_by_key(table, ["k"], "v").collect()] == [2]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "x.MP4").write_bytes(b"abc")
    assert readers.list_files(spark, str(tmp_path / "m"), ["mp4"]).count() == 1
    assert readers.file_digests(spark, str(tmp_path / "m")).first().sha256.startswith("ba7816bf")

    def probe(path):
        if "x" in path:
            return {"n": 3}
        raise OSError("unreadable")

    got = {r.path: (r.n, r.probe_error) for r in readers.probe_media(spark.createDataFrame([("x",), ("b",)], "path string"), probe, "n long").collect()}
    assert got == {"x": (3, None), "b": (None, "OSError: unreadable")}


def test_unique_append(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert sinks.unique_append(rows(1, 2), path, "id", most_rows=3) == 2
    for bad in ((2, 3), (4, 4), (None, 5), (6, 7)):
        with pytest.raises(sinks.AppendRejected):
            sinks.unique_append(rows(*bad), path, "id", most_rows=3)
    with pytest.raises(sinks.AppendRejected, match="odd"):
        sinks.unique_append(rows(9), path, "id", problem=F.when(F.col("id") % 2 == 1, "odd"))
    assert sorted(r.id for r in spark.read.schema("id long").json(path).collect()) == [1, 2]


def test_artifacts_and_staged(spark, tmp_path):
    path = str(tmp_path / "art")
    rows = spark.createDataFrame([("d", "k", "{}"), ("d", "k", "{}"), ("d", "k", "[1]")], "dataset string, kind string, content string")
    sinks.put_artifacts(rows, path)
    refs = sinks.put_artifacts(rows, path)
    assert spark.read.parquet(path).count() == 2
    assert sinks.get_artifacts(spark, refs, path).where("valid").count() == 2
    sinks.write_staged(spark.range(3), str(tmp_path / "s"), "parquet")
    sinks.write_staged(spark.range(5), str(tmp_path / "s"), "parquet")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 5
    sinks.write_document(spark.range(2), str(tmp_path / "doc.json"))
    assert json.loads((tmp_path / "doc.json").read_text()) == [{"id": 0}, {"id": 1}]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i % 3, float(i)) for i in range(30)], "k long, v double")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    fold = state.count_fold(["k"], ["v"])
    stream = spark.readStream.schema("k long, v double").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = state.snapshot_stream(stream, fold, str(tmp_path / "snap"), str(tmp_path / "cp"), "k long, n long, v double")
    query.awaitTermination()
    want = sorted(tuple(r) for r in events.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect())
    assert sorted((r.k, r.n, r.v) for r in sinks.read_version(spark, str(tmp_path / "snap"), "k long, n long, v double").collect()) == want


def test_reservations_refuse_conflicts(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "fact_id long, key string, cell string")
    held = rows((1, "a", "x"))
    assert [tuple(r) for r in state.reserve_many(held, rows((1, "a", "x"), (2, "b", "y"))).collect()] == [(2, "b", "y")]
    for bad in (rows((1, "a", "z"), (3, "c", "x")), rows((4, "a", "x"), (4, "b", "x"))):
        with pytest.raises(state.ReservationConflict):
            state.reserve_many(held, bad)


def test_pairing_equals_queue(spark):
    import random

    rng = random.Random(4)
    rows = [(k, i, rng.choice("se"), f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(120) for k in [rng.randrange(3)]]
    df = spark.createDataFrame(rows, "k long, i long, t string, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.i: r.seconds for r in telemetry.pair_calls(df, keys=["k"], order=["i"], start=F.col("t") == "s", end=F.col("t") == "e", at="at").collect()}
    queues: dict[int, list[int]] = {}
    for k, i, t, _ in rows:
        if t == "s":
            queues.setdefault(k, []).append(i)
        else:
            queue = queues.get(k, [])
            assert got[i] == (float(i - queue.pop(0)) if queue else None)


def test_upsert_keeps_last(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, at long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k long, v string, at long")
    got = state.upsert(old, new, ["k"], [F.desc("at")])
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_a_lock_is_held_by_one_writer(spark, tmp_path):
    import os

    from tessera.sources import locks

    path = f"file://{tmp_path}/t/.lock"
    with locks.exclusive(spark, path):
        with pytest.raises(locks.Locked):
            with locks.exclusive(spark, path):
                pass
    with locks.exclusive(spark, path):
        pass
    assert not os.path.exists(f"{tmp_path}/t/.lock")


def test_a_stale_lock_is_taken_over_and_not_given_up_by_its_old_writer(spark, tmp_path):
    import os

    from tessera.sources import locks

    path = f"file://{tmp_path}/t/.lock"
    with locks.exclusive(spark, path):
        os.utime(f"{tmp_path}/t/.lock", (1, 1))
        with locks.exclusive(spark, path, stale_seconds=60):
            pass
    with locks.exclusive(spark, path) as owner:
        assert owner


def test_an_append_under_another_writer_is_refused(spark, tmp_path):
    from tessera.sources import locks, sinks

    path = f"file://{tmp_path}/ledger"
    with locks.exclusive(spark, f"{path}.lock"):
        with pytest.raises(locks.Locked):
            sinks.unique_append(spark.range(3), path, "id")
    assert sinks.unique_append(spark.range(3), path, "id") == 3


GUARDED = "k string, n long, users long"


def guarded_run(spark, root, target, checkpoint="checkpoint", fold=None):
    stream = spark.readStream.schema("users long, k string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    fold = fold or state.count_fold(["k"], ["users"])
    return state.guarded_snapshot(stream, fold, f"{root}/run", f"{root}/{checkpoint}", GUARDED, spent=F.sum("users"), done=F.sum("n"), stop_at=1e9, target=target)


def guarded_state(spark, root):
    history = sorted(map(tuple, spark.read.schema("batch long, done long, reason string").json(f"{root}/run/history").collect()))
    return history, sinks.read_version(spark, f"{root}/run/latest", GUARDED).agg(F.sum("n")).first()[0]


def test_a_stopped_stream_goes_on_with_the_same_rows(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("users"), F.lit("x").alias("k")).repartition(4).write.parquet(f"{tmp_path}/in")
    assert guarded_run(spark, tmp_path, 15) == "target"
    once, n = guarded_state(spark, tmp_path)
    assert [r[0] for r in once] == list(range(len(once))) and once[-1][2] == "target" and n == once[-1][1] < 40 and all(r[2] is None for r in once[:-1])
    assert guarded_run(spark, tmp_path, 15) == "target" and guarded_state(spark, tmp_path) == (once, n)
    assert guarded_run(spark, tmp_path, 10**9) is None
    assert guarded_state(spark, tmp_path)[1] == 40 and len(guarded_state(spark, tmp_path)[0]) == 4
    assert state.budget_stop(5, 0, stop_at=5, target=9) == "budget"


def test_a_failure_between_snapshot_and_history_counts_nothing_twice(spark, tmp_path, monkeypatch):
    """The first batch has number 0, and its rows are in the snapshot when the run fails."""
    spark.range(10).select(F.col("id").alias("users"), F.lit("x").alias("k")).coalesce(1).write.parquet(f"{tmp_path}/in")
    whole = state.budget_stop
    monkeypatch.setattr(state, "budget_stop", lambda *a, **k: 1 / 0)
    with pytest.raises(Exception):
        guarded_run(spark, tmp_path, 10**9)
    assert sinks.versions(spark, f"{tmp_path}/run/latest") == [0]
    monkeypatch.setattr(state, "budget_stop", whole)
    assert guarded_run(spark, tmp_path, 10**9) is None
    assert guarded_state(spark, tmp_path) == ([(0, 10, None)], 10)


def test_an_empty_snapshot_has_its_number(spark, tmp_path):
    nothing = spark.createDataFrame([], "k long")
    assert sinks.publish_version(nothing, f"{tmp_path}/t", 0) and sinks.versions(spark, f"{tmp_path}/t") == [0]
    seen = []

    def fold(held, batch):
        seen.append(batch.count())
        return held

    for _ in range(2):
        state._take(spark.range(3).selectExpr("id AS k"), 0, fold, f"{tmp_path}/t", "k long")
    assert not seen


def test_a_version_number_is_taken_once_and_old_ones_go(spark, tmp_path):
    path, rows = f"{tmp_path}/t", lambda k: spark.createDataFrame([(k,)], "k long")
    assert sinks.read_version(spark, path, "k long").count() == 0
    assert sinks.publish_version(rows(1), path, 4) and not sinks.publish_version(rows(2), path, 4)
    for k in (5, 6, 7):
        assert sinks.publish_version(rows(k), path, k)
    assert sinks.versions(spark, path) == [5, 6, 7] and sinks.read_version(spark, path, "k long").first()[0] == 7
    assert sinks.read_version(spark, path, "k long", 5).first()[0] == 5 and not [p for p in (tmp_path / "t").iterdir() if "staged" in p.name]


def test_resume_migration_refuses_other_runs(spark):
    selection = spark.createDataFrame([(1,), (2,)], "v long")
    results = lambda *rows: spark.createDataFrame(rows, "v long, state string, selection_hash string")
    outputs = lambda *rows: spark.createDataFrame(rows, "v long, output_id string")
    got = state.migrate_resume(selection, results((1, "completed", "h"), (2, "running", "h")), outputs((1, "a"), (1, "b")), "v", "h")
    assert sorted(map(tuple, got.collect())) == [(1, "completed", 2), (2, "pending", 0)]
    for r, o in ((results((1, "completed", "g")), outputs()), (results((3, "completed", "h")), outputs()), (results(), outputs((1, "a"), (2, "a")))):
        with pytest.raises(ValueError):
            state.migrate_resume(selection, r, o, "v", "h")


def test_lines_have_their_byte_offsets_however_files_are_split(spark, tmp_path):
    import random

    rng, want = random.Random(2), []
    (tmp_path / "in").mkdir()
    for name in ("a.jsonl", "b.jsonl", "empty.jsonl"):
        lines = [] if name.startswith("empty") else [rng.choice(["", "x", "äöü", "\r", "long " * 40]) + str(i) for i in range(3000)]
        content = "\n".join(lines).encode()
        (tmp_path / "in" / name).write_bytes(content)
        at = 0
        for line in lines:
            want.append((name, at, line))
            at += len(line.encode()) + 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("10000b", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = readers.read_lines(spark, str(tmp_path / "in"))
            got = sorted((r.file.rsplit("/", 1)[-1], r.offset, r.value) for r in read.collect())
            assert got == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pairing_of_a_hot_key_in_file_order_equals_queue(spark, tmp_path):
    """One key has half of all events; files have many splits, and ranges many parts of a key."""
    import random

    rng, queues, want = random.Random(5), {}, {}
    (tmp_path / "events").mkdir()
    for f in range(2):
        with open(tmp_path / "events" / f"{f}.jsonl", "w") as out:
            for i in range(4000):
                key, kind = rng.choice(["hot", "a", "b", None, "hot", "hot"]), rng.choice("sse" if i < 2000 else "see")
                number = f * 10_000 + i
                out.write(json.dumps({"i": number, "k": key, "t": kind, "at": f"2024-01-01 {i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}"}) + "\n")
                queue = queues.setdefault((f, key), [])
                if kind == "s":
                    queue.append(i)
                else:
                    want[number] = float(i - queue.pop(0)) if queue else None
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000b")
        read = readers.read_events(spark, [str(tmp_path)], "i long, k string, t string, at timestamp", place=True)
        paired = telemetry.pair_calls(read, keys=["event_file", "k"], order=["offset"], start=F.col("t") == "s", end=F.col("t") == "e", at="at")
        assert {r.i: r.seconds for r in paired.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert None in want.values()


def test_percentiles_by_narrowing_equal_sorted_lists(spark):
    import random

    import numpy as np

    rng = random.Random(6)
    rows = [(k, rng.choice([rng.random() * 10 ** rng.randrange(-3, 9), 5.0, -rng.random()])) for k in ("hot",) * 6 + ("a", None) for _ in range(500)]
    rows += [("one", 3.0), ("none", None), ("nan", float("nan")), ("wide", 1e308), ("wide", -1e308), ("wide", 7.0), ("same", 2.0), ("same", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    values = {}
    for k, v in rows:
        if v is not None and v == v:
            values.setdefault(k, []).append(v)
    for most, bins in ((0, 4), (0, 1024), (1000, 16), (10**6, 16)):
        got = {r.k: (r.p, r.q) for r in telemetry.exact_percentiles(df, ["k"], "v", {"p": 0.5, "q": 0.9}, most=most, bins=bins).collect()}
        assert got.keys() == values.keys()
        for k, v in values.items():
            assert k == "wide" or np.allclose(got[k], np.percentile(v, [50, 90]), rtol=1e-12)
        assert got["wide"][0] == 7.0


def test_digests_by_chunks(spark, tmp_path):
    import hashlib

    for name, size in (("a b", 10), ("c", 3 * 2**20), ("d", 101)):
        (tmp_path / name).write_bytes(bytes(i % 251 for i in range(size)))
    got = {r.path.rsplit("/", 1)[-1].replace("%20", " "): r.sha256 for r in readers.file_digests(spark, str(tmp_path), most_whole=100).collect()}
    assert got == {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in tmp_path.iterdir()}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_a_stream_of_leases_equals_a_loop_and_expires_by_itself(spark, tmp_path, zone):
    """Several batches; a lease that nobody asks for again is given up once other requests have moved the time on."""
    import random

    from tessera.streaming import leases

    rng, minute = random.Random(3), 60_000_000
    start, requests = 1_704_067_200_000_000, []
    for i in range(300):
        kind = rng.choice(["active", "pending", "failed"])
        requests.append((rng.choice([1, 2, 3, None]), i, start + i * 7 * minute, kind, rng.choice([None, start + i * 7 * minute + rng.randrange(60, 600) * minute]) if kind == "active" else None, f"u{i}"))
    requests.insert(0, (9, 1000, start, "active", start + 180 * minute, "lonely"))
    want, held = [], {}
    for lease, number, at, kind, expires, uri in requests:
        if lease not in held or at >= held[lease][0]:
            ends = [expires - 120 * minute] if expires else []
            held[lease] = (-1 if kind == "failed" else min([*ends, *([at + 15 * minute] if kind == "pending" else [])], default=2**62), uri)
            want.append((lease, number, uri, "claimed"))
        else:
            want.append((lease, number, held[lease][1], "reused"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame(requests, "lease_id long, request_id long, at long, state string, expires_at long, uri string")
        rows = rows.withColumns({"at": F.timestamp_micros("at"), "expires_at": F.timestamp_micros("expires_at")})
        for k in range(3):
            rows.where(F.col("request_id").between(k * 100, k * 100 + 99) | (F.lit(k == 0) & (F.col("request_id") == 1000))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(leases.REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with leases.keyed_store(spark):
            query = leases.lease_decisions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).withColumn("at", F.unix_micros("at")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert sorted((r.request_id, r.lease_id or 0, r.uri, r.outcome) for r in got if r.outcome != "expired") == sorted((n, k or 0, u, o) for k, n, u, o in want)
    assert (9, start + 60 * minute, "lonely") in [(r.lease_id, r.at, r.uri) for r in got if r.outcome == "expired"]


def test_policies_are_loaded_whole_or_not_at_all(spark, tmp_path):
    import hashlib

    (tmp_path / "sub").mkdir()
    files = {"a.yaml": "x: 1\n", "sub/b.json": "{}\n"}
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = [(n, hashlib.sha256(t.encode()).hexdigest()) for n, t in files.items()]
    table = lambda r: spark.createDataFrame(r, "name string, sha256 string")
    assert {r.name: r.content for r in readers.load_policies(spark, str(tmp_path), table(rows)).collect()} == files
    for bad in (rows[:1], [*rows, ("c", "0")], [(rows[0][0], "0"), rows[1]], [(rows[0][0], None), rows[1]]):
        with pytest.raises(ValueError):
            readers.load_policies(spark, str(tmp_path), table(bad))


def test_yaml_rows(spark):
    pytest.importorskip("yaml")
    assert [tuple(r) for r in readers.yaml_rows(spark, "- {a: 1, b: x}\n- {a: 2}\n", "a int, b string").collect()] == [(1, "x"), (2, None)]
