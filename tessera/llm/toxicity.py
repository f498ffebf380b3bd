"""Operator 2: toxicity by two class-conditional Kneser-Ney models over shared backoff counts.

Words become 64-bit hashes in the JVM; each labelled document then counts once for every different
pair of neighbouring words. A word has the counts of the pairs that end in it, and a beginning of
seven or five letters those of its words. A class's model takes its own counts less an absolute discount, one for each class and
order, and leaves what it takes off to the next order:

    P(v | u) = max(c(u, v) - D, 0) / c(u)  +  left(u) P(v)
    P(v)     = max(c(v) - D, 0) / C        +  left    P(s7) S(v) / S(s7)
    P(s7)    = max(c(s7) - D, 0) / C7      +  left    P(s5) S(s7) / S(s5)       and likewise for s5

where left is the share of the counts that the discount has taken, so that every distribution sums
to one. S is what both classes share: the number of different words that a word follows in either
class, summed up over beginnings, with one more below each for words never seen. Rare expressions
therefore take the same value in both models, and tell the classes apart by their beginnings only.

Of the counts a model keeps what exceeds its discounts, so it grows with the labelled rows. A
document's likelihoods are compared word by word: by the mean over its words, and by the mean over
the few words that speak most for toxicity; a logistic function of these is fitted on labelled
documents that were kept out of the counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents
from .packing import mix64

#: Beginnings of words, from the longest; a shorter word is its own beginning.
STEMS = (7, 5)
#: Orders of the models: pairs, words, and beginnings from the longest.
PAIR, SINGLE, LAST = 0, 1, 1 + len(STEMS)
#: What the estimated discount of each order is multiplied by.
STRENGTHS = (6.0, 4.0, 8.0, 16.0)
CLASSES = ("ordinary", "toxic")
#: Context of the first word.
START = 0
#: Words of a document that speak most for toxicity.
TOP = (3, 8)


def words_of(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def hashed_words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, and arrays of 64-bit hashes: w1 of the words, w2 and on of their beginnings."""
    words = docs.select(*keep, words_of(F.col("text")).alias("words"))
    stem = lambda n: F.transform("words", lambda w: F.xxhash64(F.substring(w, 1, n)))
    return words.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("w1"), *[stem(n).alias(f"w{k}") for k, n in enumerate(STEMS, SINGLE + 1)])


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64)).view(np.int64)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _once(owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each distinct key of each row first stands."""
    return np.unique(mix64(keys.view(np.uint64) + mix64(owner.astype(np.uint64) + np.uint64(1))), return_index=True)[1]


def _contexts(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[(np.cumsum(lengths) - lengths)[lengths > 0]] = START
    return before


#: Both classes' counts travel as one number, toxic documents by this.
TOXIC = 1 << 32


def count_pairs(labelled: DataFrame) -> DataFrame:
    """a, b, ordinary, toxic: documents of either class with word b after a, for rows of w1 and toxic.

    A pair counts once for a document, so that one long or repetitive text does not stand for its
    class. Batches are summed before they are sent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, lengths = _flat(batch.column("w1"))
            if not len(words):
                continue
            owner = np.repeat(np.arange(len(lengths)), lengths)
            before = _contexts(words, lengths)
            keys = pair_keys(before, words)
            first = _once(owner, keys)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)[owner[first]]
            _, at, place, n = np.unique(keys[first], return_index=True, return_inverse=True, return_counts=True)
            bad = np.bincount(place, weights=toxic, minlength=len(at)).astype(np.int64)
            some = first[at]
            yield pa.RecordBatch.from_arrays([pa.array(before[some]), pa.array(words[some]), pa.array(n - bad + bad * TOXIC)], names=["a", "b", "n"])

    found = labelled.mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return found.select("a", "b", F.pmod("n", F.lit(TOXIC)).cast("int").alias("ordinary"), F.floor(F.col("n") / TOXIC).cast("int").alias("toxic"))


def discounts_of(tables: list[DataFrame], strengths: tuple[float, ...]) -> dict[tuple[int, str], tuple[float, float, float]]:
    """(discount, counts, share of them that the discount takes) of every order and class.

    The discount is the usual estimate from how many items were counted once and twice, times
    the order's strength; the share holds for a whole order (pairs have one for each context).
    """
    out = {}
    for level, table in enumerate(tables):
        ones = [F.count_if(F.col(c) == n) for c in CLASSES for n in (1, 2)]
        found = table.agg(*ones, *[F.coalesce(F.sum(c), F.lit(0)) for c in CLASSES]).first()
        discount = {c: strengths[level] * (found[2 * i] / (found[2 * i] + 2 * found[2 * i + 1]) if found[2 * i] else 0.5) for i, c in enumerate(CLASSES)}
        cut = table.agg(*[F.coalesce(F.sum(F.least(F.col(c).cast("double"), F.lit(discount[c]))), F.lit(0.0)) for c in CLASSES]).first()
        for i, c in enumerate(CLASSES):
            total = float(found[4 + i])
            out[level, c] = discount[c], total, cut[i] / total if total else 1.0
    return out


def fit_models(scratch: Scratch, labelled: DataFrame, strengths: tuple[float, ...] = STRENGTHS) -> tuple[DataFrame, list[float]]:
    """(level, a, b, gap) of all that the models keep, and what each order adds to the gap of an item that it does not keep.

    `gap` is log P(toxic) - log P(ordinary) of the pair (level 0) or the word (level 1), or that of a
    beginning; rows of level -1 have what a context leaves to its words. An item without a row
    has the gap of the next shorter beginning, and what its order adds.
    """
    names = [f"w{k}" for k in range(SINGLE, LAST + 1)]
    hashed = hashed_words(labelled, ["toxic"])
    chains = scratch.cut(hashed.select(F.explode(F.arrays_zip(*names)).alias("w")).select("w.*").distinct())
    pairs = scratch.cut(count_pairs(hashed.select("toxic", "w1")))

    # Words, and up their beginnings: counts, and what both classes share, with one more below each for words never seen.
    sums = [F.sum(c).alias(c) for c in CLASSES]
    words = pairs.groupBy(F.col("b").alias("w1")).agg(*sums, F.count("*").alias("s")).join(chains, "w1")
    tables = {SINGLE: scratch.cut(words.select(F.col("w1").alias("a"), F.col("w2").alias("b"), *names, *CLASSES, "s"))}
    for level in range(SINGLE + 1, LAST + 1):
        up = F.col(f"w{level + 1}") if level < LAST else F.lit(0).cast("long")
        rest = [F.first(n).alias(n) for n in names[level - 1 :]]
        own = tables[level - 1].groupBy(F.col(f"w{level}").alias("a")).agg(*sums, (F.sum("s") + 1).alias("s"), *rest)
        tables[level] = scratch.cut(own.withColumn("b", up))
    root = (tables[LAST].agg(F.sum("s")).first()[0] or 0) + 1
    orders = discounts_of([pairs, *tables.values()], strengths)
    kept = lambda c, level: F.greatest(F.col(c) - F.lit(orders[level, c][0]), F.lit(0.0))
    some = lambda level: sum((kept(c, level) for c in CLASSES), F.lit(0.0)) > 0

    # From the shortest beginnings down: lift is what a class gives an item over what both share.
    lifts = {}
    for level in range(LAST, 0, -1):
        if level == LAST:
            rows = tables[level].withColumns({f"up_{c}": F.lit(1.0) for c in CLASSES})
        else:
            rows = tables[level].join(lifts[level + 1].select(F.col("a").alias("b"), *[F.col(f"lift_{c}").alias(f"up_{c}") for c in CLASSES]), "b")
        lift = {f"lift_{c}": kept(c, level) / F.lit(orders[level, c][1] or 1.0) / (F.col("s") / root) + F.lit(orders[level, c][2]) * F.col(f"up_{c}") for c in CLASSES}
        lifts[level] = scratch.cut(rows.withColumns(lift).select("a", "s", *lift, some(level).alias("some")))

    # Pairs: contexts' totals and what they leave to their words.
    cut = lambda c: F.least(F.col(c).cast("double"), F.lit(orders[PAIR, c][0]))
    contexts = pairs.groupBy("a").agg(*[F.sum(c).alias(f"n_{c}") for c in CLASSES], *[F.sum(cut(c)).alias(f"cut_{c}") for c in CLASSES], F.max(some(PAIR)).alias("any"))
    left = [F.when(F.col(f"n_{c}") > 0, F.col(f"cut_{c}") / F.col(f"n_{c}")).otherwise(1.0).alias(f"left_{c}") for c in CLASSES]
    contexts = scratch.cut(contexts.where("any").select("a", *[f"n_{c}" for c in CLASSES], *left))
    single = lifts[SINGLE].select(F.col("a").alias("b"), *[(F.col("s") / root * F.col(f"lift_{c}")).alias(f"p_{c}") for c in CLASSES])
    heavy = pairs.where(some(PAIR)).join(contexts, "a").join(single, "b")
    chance = {c: F.when(F.col(f"n_{c}") > 0, kept(c, PAIR) / F.col(f"n_{c}")).otherwise(0.0) + F.col(f"left_{c}") * F.col(f"p_{c}") for c in CLASSES}
    gap = lambda p: F.log(p["toxic"] / p["ordinary"]).alias("gap")
    none = F.lit(None).cast("long").alias("b")
    model = heavy.select(F.lit(PAIR).alias("level"), "a", "b", gap(chance))
    model = model.unionByName(contexts.select(F.lit(-1).alias("level"), "a", none, gap({c: F.col(f"left_{c}") for c in CLASSES})))
    for level, rows in lifts.items():
        model = model.unionByName(rows.where("some").select(F.lit(level).alias("level"), "a", none, gap({c: F.col(f"lift_{c}") for c in CLASSES})))
    model = scratch.cut(model)
    scratch.free(chains, pairs, contexts, *tables.values(), *lifts.values())
    return model, [math.log(orders[k, "toxic"][2] / orders[k, "ordinary"][2]) if k else 0.0 for k in range(LAST + 1)]


def model_arrays(model: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Keys in order and gaps of each level; the caller has checked how many there are."""
    table = model.toArrow()
    level, a, gap = (table.column(c).to_numpy() for c in ("level", "a", "gap"))
    b = table.column("b").fill_null(0).to_numpy()
    out = {}
    for k in range(-1, LAST + 1):
        here = level == k
        keys = pair_keys(a[here], b[here]) if k == PAIR else a[here]
        order = np.argsort(keys)
        out[k] = keys[order], gap[here][order].astype(np.float32)
    return out


def compared_here(docs: DataFrame, model: DataFrame, adds: list[float], keep: list[str]) -> DataFrame:
    """`keep`, n, mean, top0, top1: with a model small enough to be sent to every task."""
    arrays = docs.sparkSession.sparkContext.broadcast(model_arrays(model))

    def look(level: int, keys: np.ndarray, otherwise) -> np.ndarray:
        known, gaps = arrays.value[level]
        if not len(known):
            return otherwise + np.zeros(len(keys))
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[place] == keys, gaps[place], otherwise)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                words, lengths = _flat(batch.column("w1"))
                owner = np.repeat(np.arange(len(lengths)), lengths)
                before = _contexts(words, lengths)
                keys = pair_keys(before, words)
                first = np.sort(_once(owner, keys))
                different, place = np.unique(words[first], return_index=True)
                gap = np.zeros(len(different))
                for level in range(LAST, 0, -1):
                    own = different if level == SINGLE else _flat(batch.column(f"w{level}"))[0][first][place]
                    gap = look(level, own, gap + adds[level])
                gap = gap[np.searchsorted(different, words[first])] + look(-1, before[first], 0.0)
                gap = look(PAIR, keys[first], gap)
                n = np.bincount(owner[first], minlength=batch.num_rows)
                order = np.lexsort((-gap, owner[first]))
                ranked, ends = gap[order], np.cumsum(n)
                turn = np.arange(len(ranked)) - np.repeat(ends - n, n)
                sums = lambda some: np.bincount(owner[first][some], weights=ranked[some], minlength=batch.num_rows)
                mean = sums(np.ones(len(ranked), dtype=bool)) / np.maximum(n, 1)
                tops = [sums(turn < k) / k for k in TOP]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(n.astype(np.int64)), *map(pa.array, (mean, *tops))], names=[*keep, *MEASURES])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return hashed_words(docs, keep).mapInArrow(run, f"{schema}, n long, mean double, top0 double, top1 double")


MEASURES = ["n", "mean", "top0", "top1"]


def compared_by_joins(scratch: Scratch, docs: DataFrame, model: DataFrame, adds: list[float], keep: list[str]) -> DataFrame:
    """The same for a model of any size: every word of a document meets what the models keep of it in joins."""
    rows = scratch.cut(hashed_words(docs, keep).withColumn("row", F.monotonically_increasing_id()))
    names = [f"w{k}" for k in range(SINGLE, LAST + 1)]
    items = F.transform(F.arrays_zip(*names), lambda x, i: F.struct(F.when(i == 0, F.lit(START).cast("long")).otherwise(F.get("w1", i - 1)).alias("u"), *[x[n].alias(n) for n in names]))
    words = rows.select("row", F.explode(F.array_distinct(items)).alias("i")).select("row", "i.*").withColumn("gap", F.lit(0.0))
    part = lambda level, *on: model.where(f"level = {level}").select(*[F.col(x).alias(f"_{y}") for x, y in on], F.col("gap").alias("_gap"))
    for level in range(LAST, 0, -1):
        words = words.join(part(level, ("a", "w")), F.col(f"w{level}") == F.col("_w"), "left").withColumn("gap", F.coalesce("_gap", F.col("gap") + adds[level])).drop("_w", "_gap")
    words = words.join(part(-1, ("a", "u")), F.col("u") == F.col("_u"), "left").withColumn("gap", F.col("gap") + F.coalesce("_gap", F.lit(0.0))).drop("_u", "_gap")
    words = words.join(part(PAIR, ("a", "u"), ("b", "w")), (F.col("u") == F.col("_u")) & (F.col("w1") == F.col("_w")), "left").withColumn("gap", F.coalesce("_gap", "gap"))
    listed = words.groupBy("row").agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.sort_array(F.collect_list("gap"), asc=False).alias("gaps"))
    tops = [(F.aggregate(F.slice("gaps", 1, k), F.lit(0.0), lambda a, x: a + x) / k).alias(f"top{i}") for i, k in enumerate(TOP)]
    out = rows.select("row", *keep).join(listed.select("row", "n", "mean", *tops), "row", "left")
    return out.select(*keep, *[F.coalesce(m, F.lit(0)).alias(m) for m in MEASURES])


def predictors(n, mean, top0, top1, sqrt, log1p) -> list:
    """What the logistic function takes: all by the word or by a fixed number of words, and the length itself."""
    return [mean, mean * sqrt(n), top0, top1, log1p(n)]


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and offset of P(y = 1), by Newton's method; one class alone gives its constant."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 0.0 if not len(y) else (4.0 if y[0] else -4.0)
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([x / spread, np.ones(len(x))])
    b = np.zeros(design.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(b))
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1] / spread, float(b[-1])


def score_toxicity(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), strengths: tuple[float, ...] = STRENGTHS,
    calibration_rows: int = 20_000, broadcast_labels: int = 1_000_000, broadcast_model: int = 10_000_000,
) -> DataFrame:
    """`keep` (doc_id among them), held_out, score, predicted for every row of `docs`.

    `labels` (doc_id, toxic) are learned from only where crc32(doc_id as text) mod 5 is not 0.
    Of these, about `calibration_rows` at most, picked by hash from one part in six (by crc32 / 5),
    fit the logistic function; all the rest is counted. Up to `broadcast_labels` labels (counted
    first, about 40 bytes each) are broadcast, so that texts stay where they are; more are joined
    by a shuffle. A model of up to `broadcast_model` entries (counted first, 12 bytes each) is
    sent to the tasks; a larger one is joined. Null labels and doc_ids teach nothing; a label
    given twice counts once (the larger). Null and empty texts have no words and one common
    score; without labels of both classes all scores are 0.5 or the one class's. Scores use the
    text alone. Rows repeat as they come; very long texts are read whole; an empty table gives
    an empty result; other columns are ignored.
    """
    scratch = Scratch(spark)
    code = F.crc32(F.col("doc_id").cast("string"))
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.where(code % 5 != 0).withColumn("calibrates", F.floor(code / 5) % 6 == 0)
    n, calibrating = known.agg(F.count("*"), F.count_if("calibrates")).first()
    labelled = docs.select("doc_id", "text").join(F.broadcast(known) if n <= broadcast_labels else known, "doc_id")
    share = max(1, -(-calibrating // calibration_rows))
    picked = F.col("calibrates") & (F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    model, adds = fit_models(scratch, labelled.where(~picked), strengths)
    compare = compared_here if model.count() <= broadcast_model else lambda *x: compared_by_joins(scratch, *x)

    sample = compare(labelled.where(picked).select("text", "toxic"), model, adds, ["toxic"]).where("n > 0").toArrow()
    columns = {c: sample.column(c).to_numpy() for c in [*MEASURES, "toxic"]}
    seen = predictors(*(columns[m] for m in MEASURES), np.sqrt, np.log1p)
    weights, offset = fit_logistic(np.stack(seen, axis=1).astype(float), columns["toxic"].astype(float))

    scored = compare(docs, model, adds, list(keep))
    log_odds = sum((x * float(w) for x, w in zip(predictors(*map(F.col, MEASURES), F.sqrt, F.log1p), weights, strict=True)), F.lit(offset))
    out = scored.withColumn("held_out", F.coalesce(code % 5 == 0, F.lit(True))).withColumn("score", 1 / (1 + F.exp(-log_odds)))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).select(*keep, "held_out", "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark, documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
