"""A corpus pipeline: toxic documents go, near-duplicates and repeated passages go, sources are mixed, texts packed.

Each stage reads what its predecessor wrote and hands on the columns of `documents`; the last
gives the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, Scratch, documents
from tessera.llm.jaccard import jaccard_join
from tessera.llm.mixing import mix_sources, taken_words, word_count
from tessera.llm.packing import pack_documents
from tessera.llm.suffix_dedup import remove_repeats
from tessera.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, learned from the labelled part of `docs`, do not predict as toxic.

    Every row is judged by its own text; null and empty texts have one score, which rests on the
    labels. Rows without a doc_id teach nothing.
    """
    scored = score_toxicity(spark, docs, documents(spark, sf_dir, "labels"), keep=tuple(COLUMNS))
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row: that of least doc_id (null last), and of several the first as read.

    Rows are numbered, so each is judged by its own text, whether or not its doc_id is null or
    repeats. Rows without words are in no class and stay.
    """
    scratch = Scratch(spark)
    rows = scratch.cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    joined = scratch.cut(jaccard_join(spark, rows.select(F.col("_row").alias("doc_id"), "text")))
    named = joined.select(F.col("doc_id").alias("_row"), F.col("class_id").alias("_class")).join(rows.select("_row", "doc_id"), "_row")
    first = named.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first"))
    return rows.join(first.select("first._row"), "_row", "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that start earlier; documents of which nothing is left go.

    Null and empty texts stay, as do rows without a doc_id, which are not compared. Rows that
    repeat a doc_id are documents of their own.
    """
    cut = remove_repeats(spark, docs, keep=("doc_id", "lang", "source", "n_chars"))
    left = cut.where("n_removed = 0 or n_removed < n_bytes")
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; one that it takes in part gives a row of its first words.

    Texts without words have nothing to take and go; a null source is a source of its own.
    Rows without a doc_id, or with one that repeats, each have a place of their own in the mix.
    Those that agree in doc_id, source and size are matched with their places one to one, in the
    order of their other columns; other rows need their doc_id alone.
    """
    taken = Scratch(spark).cut(taken_words(mix_sources(spark, docs)).select("doc_id", "source", "size", "taken", "line_start"))
    ids = taken.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("taken").alias("taken"))
    single = ids.where("doc_id is not null and n = 1 and taken > 0").select("doc_id", "size", "taken")
    rows = docs.select(*COLUMNS).join(single, "doc_id").select(*COLUMNS, "size", "taken")
    shared = ids.where("doc_id is null or n > 1").select(F.col("doc_id").alias("_id"))
    if not shared.isEmpty():
        same = ["doc_id", "source", "size"]
        some = lambda df: df.join(shared, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        turn = lambda *order: F.row_number().over(Window.partitionBy(*same).orderBy(*order))
        places = some(taken).withColumn("turn", turn("line_start")).select(*[F.col(c).alias(f"_{c}") for c in (*same, "turn")], "taken")
        own = some(docs.select(*COLUMNS, word_count().alias("size"))).withColumn("turn", turn(F.xxhash64("text"), "text", "lang", "n_chars"))
        matched = own.join(places.where("taken > 0"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*same, "turn")])
        rows = rows.unionByName(matched.select(*COLUMNS, "size", "taken"))
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    copies = rows.where("taken >= size").withColumn("_", F.explode(F.sequence(F.lit(1), whole))).select(*COLUMNS)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), rest.cast("int"))
    parts = rows.where(rest > 0).withColumn("text", F.array_join(words, " ")).withColumn("n_chars", F.length("text").cast("long"))
    return copies.unionByName(parts.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 tokens, neighbours along the curve together.

    Null and empty texts are one end token each; rows that repeat are packed each.
    """
    return pack_documents(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("mix_sources", mix),
    ("pack_hilbert", pack),
]

#: The models of the first stage, the tokenizer of the last, and bytes of suffixes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
