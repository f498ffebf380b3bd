"""The pipeline's stages on the small table, each against what it should have done with its own input."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_stages_hand_on_documents(stages):
    for _, after in stages[:-1]:
        assert after.columns == corpus_pipeline.COLUMNS
    assert len(corpus_pipeline.STAGES) == 5


def test_stage_effects(stages):
    (raw, clean), (_, single), (_, cut), (_, mixed), (_, pieces) = stages
    scored = {r.doc_id: r.predicted for r in registry.QUERIES["op2_toxicity"](raw.sparkSession, SF).collect()}
    assert sorted(r.doc_id for r in clean.collect()) == sorted(d for d, bad in scored.items() if not bad)
    assert single.select("text").distinct().count() == single.count()
    texts = {r.doc_id: r.text for r in single.collect()}
    assert all(len(r.text) <= len(texts[r.doc_id]) for r in cut.collect())
    size = {r.doc_id: len(r.text.split()) for r in cut.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert all(n <= 2 * size[d] for d, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 30
    assert pieces.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0


def test_mix_keeps_rows_without_or_with_repeated_ids(spark):
    rows = [(None, "a b c", "en", "x", 5), (None, "d e f g", "en", "x", 7), (1, "h i", "en", "x", 3), (1, "j k l m n", "en", "x", 9), (2, "o p q", "en", None, 5), (2, "r s t", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = corpus_pipeline.taken_words(corpus_pipeline.mix_sources(spark, docs)).collect()
    want, got = {}, {}
    for r in taken:
        key = r.doc_id, r.source
        want[key] = want.get(key, 0) + r.taken
    for r in corpus_pipeline.mix(spark, docs, SF).collect():
        assert any(t.startswith(r.text) for d, t, *_ in rows if d == r.doc_id)
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + len(r.text.split())
    assert got == {k: n for k, n in want.items() if n}


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, repeated ids with other texts, clashing columns."""
    long = " ".join(f"word{i}" for i in range(4000))
    passage = "this passage stands in several documents and is well over one hundred bytes long so that it has to go from all but one "
    rows = [
        (None, "a row without an id", "en", "x", 19), (None, "a row without an id", "en", "x", 19), (1, "one two three four five six", None, None, None), (1, "seven eight nine ten eleven", "en", "x", 27), (1, "seven eight nine ten eleven", "en", "x", 27),
        (2, None, "en", "x", None), (3, "", "en", "x", 0), (4, " \n ", "en", None, 3), (5, long, "en", "y", len(long)), (6, long + " more", "en", "y", len(long) + 5), (7, passage + "first end", "en", "y", 1), (8, "other start " + passage, "de", "y", 1), (9, "one two three four five six", "en", "z", 27),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumn("_row", F.lit("mine")).withColumn("size", F.lit("mine")).withColumn("id", F.lit("mine"))


def texts(df):
    return sorted((str(r.doc_id), r.text or "") for r in df.collect())


def test_stages_on_odd_rows(spark):
    docs = odd_documents(spark)
    stage = dict(corpus_pipeline.STAGES)
    mild = stage["toxicity"](spark, docs, SF)
    assert mild.columns == corpus_pipeline.COLUMNS and not Counter(texts(mild)) - Counter(texts(docs))
    mixed = stage["mix_sources"](spark, docs, SF)
    given = [t.split() for _, t in texts(docs)]
    assert mixed.columns == corpus_pipeline.COLUMNS and all(t.strip() and any(g[: len(t.split())] == t.split() for g in given) for _, t in texts(mixed))
    assert {d for d, _ in texts(mixed)} >= {"None", "1", "5", "6"}  # rows without an id and those that share one are mixed, each by its own words
    single = stage["ngram_jaccard"](spark, docs, SF)
    assert single.columns == corpus_pipeline.COLUMNS
    got = [(d, t.split()[:3]) for d, t in texts(single)]
    assert sorted(d for d, _ in got) == ["1", "1", "2", "3", "4", "5", "7", "None"]  # 8 shares 19 of 23 shingles with 7
    cut = stage["suffix_dedup"](spark, docs, SF)
    assert sum(t.count("several documents") for _, t in texts(cut)) == 1 and [d for d, _ in texts(cut) if d in "234"] == ["2", "3", "4"]
    assert sorted(d for d, _ in texts(cut)).count("None") == 2
    pieces = stage["pack_hilbert"](spark, docs, SF).collect()
    assert sum(r.doc_tokens for r in pieces if r.start == 0) == sum(r.length for r in pieces)
    assert sum(r.start == 0 for r in pieces) == docs.count()


def test_stages_on_empty_tables(spark):
    none = odd_documents(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_run_gives_the_last_stage(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32, r.sequence_id, r.offset)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[-1][1].collect()))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLES[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_registered():
    assert {f"op{n}_" for n in range(1, 14)} == {q[: q.index("_") + 1] for q in registry.QUERIES}
    assert entry.queries()["pipeline"] is corpus_pipeline.run
