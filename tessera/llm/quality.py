"""Operator 4: quality rules, and robust multivariate outliers by language and source.

Counts are taken from every whole text with array functions. Documents that pass the base rules
are then judged against their group: from several starts concentration steps (distances, the
closest share of the group, its mean and covariance, again) go on to covariances of a small
determinant, of which the least is the group's estimate; documents far from it by Mahalanobis
distance are rejected.

Only built-in functions are used. Each step is two aggregates with partial sums, and estimates come
to the rows by broadcast behind a check of their number, so a hot group costs no more than others;
the table of groups has one row for each language and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CHARS, WORD, Scratch, documents, let, with_estimates

SYMBOLS = "#*$%&|<>"
#: Transformed statistics, and the least standard deviation each is given in any group.
FEATURES = {"f_words": 0.25, "f_length": 0.5, "f_symbols": 0.5, "f_lines": 0.5, "f_repeats": 0.1}
NAMES = list(FEATURES)
#: Median of the chi-square distribution with five degrees of freedom.
CHI2_MEDIAN = 4.3515


def _covered(windows: Column) -> Column:
    """Words in those 3-word windows (given by hash) that occur twice or more: sort, look at neighbours."""

    def positions(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def length(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(pairs, lambda s: let(positions(s), length))


def _repeats(words: Column) -> Column:
    n = F.size(words) - 2
    windows = F.zip_with(
        F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.xxhash64(a, b)), F.slice(words, 3, n), lambda h, c: F.xxhash64(h, c)
    )
    repeated = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(_covered(g)))
    return F.when(F.size(words) < 3, 0).otherwise(repeated)


def _duplicate_lines(text: Column) -> Column:
    worded = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    return let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def text_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns, the counts of each whole text, and base_failed; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), _repeats(w).alias("r")))
    out = docs.select(
        *keep,
        words.alias("_w"),
        F.length(F.translate(text, BLANK_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _duplicate_lines(text).cast("long").alias("n_dup_lines"),
    )
    out = out.withColumn("n_words", F.col("_w.n").cast("long")).withColumn("n_repeat_words", F.col("_w.r").cast("long")).drop("_w")
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def features() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = [
        F.log1p("n_words"),
        F.col("word_chars") / words,
        F.log1p(1000 * F.col("n_symbols") / words),
        F.log1p("n_dup_lines"),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return [v.alias(k) for k, v in zip(NAMES, values, strict=True)]


def _moments(df: DataFrame, keys: list[str]) -> DataFrame:
    """By `keys`: the mean, the Cholesky factor of the covariance, and the log determinant.

    A statistic of which the others leave less than its least variance has that variance.
    """
    p = range(len(NAMES))
    sums = [F.avg(NAMES[i]).alias(f"m{i}") for i in p]
    products = [F.avg(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q{i}{j}") for i in p for j in p if j <= i]
    out = df.groupBy(*keys).agg(F.count("*").alias("inside"), *sums, *products)
    for i in p:
        for j in range(i + 1):
            value = F.col(f"q{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FEATURES[NAMES[i]] ** 2))) if i == j else value / F.col(f"l{j}{j}"))
    logdet = sum((2 * F.log(F.col(f"l{i}{i}")) for i in p), F.lit(0.0))
    return out.select(*keys, "inside", *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in range(i + 1)], logdet.alias("logdet"))


def _distance(df: DataFrame, estimate: DataFrame, keys: list[str], n: int, how: str = "inner") -> DataFrame:
    """`d2`: the squared Mahalanobis distance from the `n` estimates, by forward substitution."""
    out = with_estimates(df, estimate, keys, n, how)
    for i in range(len(NAMES)):
        value = F.col(NAMES[i]) - F.col(f"m{i}")
        for k in range(i):
            value = value - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", value / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"z{i}") ** 2 for i in range(len(NAMES))), F.lit(0.0)))


#: Starts of the concentration steps: distances by scale alone, by the covariance of bounded values, and by that of directions.
STARTS = ("scaled", "bounded", "directions")


def _starts(scratch: Scratch, rows: DataFrame, n: int, accuracy: int) -> DataFrame:
    """`rows` once for each start, with d2: the distance from the group's medians that it takes."""
    keys = ["group"]
    middle = rows.groupBy("group").agg(*[F.percentile_approx(c, F.lit(0.5), F.lit(accuracy)).alias(f"c_{c}") for c in NAMES])
    centred = with_estimates(rows, scratch.cut(middle), keys, n, "inner")
    spread = centred.groupBy("group").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"c_{c}")), F.lit(0.5), F.lit(accuracy)).alias(f"s_{c}") for c in NAMES])
    scale = {c: F.greatest(1.4826 * F.col(f"s_{c}"), F.lit(FEATURES[c])) for c in NAMES}
    z = {c: (F.col(c) - F.col(f"c_{c}")) / scale[c] for c in NAMES}
    scaled = with_estimates(centred, scratch.cut(spread), keys, n, "inner").select("group", *NAMES, *[z[c].alias(f"x_{c}") for c in NAMES])
    size = F.sqrt(sum((F.col(f"x_{c}") ** 2 for c in NAMES), F.lit(1e-12)))
    shapes = {"bounded": {c: F.tanh(f"x_{c}") for c in NAMES}, "directions": {c: F.col(f"x_{c}") / size for c in NAMES}}
    out = scaled.select("group", F.lit(STARTS[0]).alias("start"), *NAMES, (size**2).alias("d2"))
    for start, shape in shapes.items():
        own = scratch.cut(_moments(scaled.select("group", *[v.alias(c) for c, v in shape.items()]), keys)).withColumns({f"m{i}": F.lit(0.0) for i in range(len(NAMES))})
        plain = scaled.select("group", *[F.col(c).alias(f"y_{c}") for c in NAMES], *[F.col(f"x_{c}").alias(c) for c in NAMES])
        far = _distance(plain, own, keys, n)
        out = out.unionByName(far.select("group", F.lit(start).alias("start"), *[F.col(f"y_{c}").alias(c) for c in NAMES], "d2"))
    return out


def covariance_estimates(scratch: Scratch, rows: DataFrame, *, h: float = 0.75, most_steps: int = 20, settled: float = 1e-3, accuracy: int = 2000) -> DataFrame:
    """Minimum-covariance-determinant estimates of each group of `rows` (group and the features).

    From each start the share `h` of a group with the least distances gives the first
    covariance; concentration steps follow until a start's log determinant moves by no more
    than `settled`, after which its rows are left alone, and the start with the least one wins. The quantiles are mergeable sketches.
    """
    keys = ["group", "start"]
    n = rows.agg(F.approx_count_distinct("group", 0.01)).first()[0] * 2 * len(STARTS)

    def concentrated(measured: DataFrame) -> DataFrame:
        edge = scratch.cut(measured.groupBy(*keys).agg(F.percentile_approx("d2", F.lit(h), F.lit(accuracy)).alias("edge")))
        inside = with_estimates(measured, edge, keys, n, "inner").where("d2 <= edge")
        return scratch.cut(_moments(inside.select(*keys, *NAMES), keys))

    started = scratch.cut(_starts(scratch, rows, n, accuracy))
    moving, estimate = concentrated(started), None
    each = started.select(*keys, *NAMES)
    for step in range(most_steps):
        following = concentrated(_distance(each, moving, keys, n).select(*keys, *NAMES, "d2"))
        moved = F.abs(F.col("logdet") - F.col("was")) > settled
        known = scratch.cut(following.join(moving.select(*keys, F.col("logdet").alias("was")), keys).withColumn("moved", F.coalesce(moved, F.lit(False))))
        scratch.free(moving, following)
        ended = known.where(~F.col("moved") if step + 1 < most_steps else F.lit(True)).drop("was", "moved")
        estimate = ended if estimate is None else estimate.unionByName(ended)
        moving = known.where("moved").drop("was", "moved")
        if moving.isEmpty():
            break
    estimate = scratch.cut(estimate)
    columns = [c for c in estimate.columns if c not in keys]
    best = estimate.groupBy("group").agg(F.min_by(F.struct(*columns), F.struct("logdet", "start")).alias("e"))
    return scratch.cut(best.select("group", "e.*"))


def quality_verdicts(spark: SparkSession, docs: DataFrame, *, cutoff: float = 80.0, least_group: int = 50, keep: tuple[str, ...] = ("doc_id",), **fit) -> DataFrame:
    """One row a document: its counts, base_failed, distance and kept.

    Distances are scaled so that a group's median is that of the chi-square law, and a document
    is kept up to `cutoff` (in squares: far beyond the 0.9999 quantile, 25.7, as clean documents
    have heavy tails; of the labelled test documents the good ones lie below 40, the others
    above 120). Languages' sources with fewer than `least_group` documents that pass the base
    rules are pooled into one group of their language; if that is too small as well it has no
    estimate, and its documents are kept with a null distance. Null languages and sources form
    groups of their own; null and empty texts fail the base rules; very long texts are read
    whole; repeated rows are judged each; an empty table gives an empty result; other columns
    are ignored.
    """
    scratch = Scratch(spark)
    named = docs.select(*keep, "text", F.to_json(F.struct("lang", "source")).alias("_fine"), F.to_json(F.struct("lang")).alias("_pool"))
    counted = scratch.cut(text_statistics(named, [*keep, "_fine", "_pool"]))
    fine = counted.where("not base_failed").groupBy("_fine").count().where(F.col("count") >= least_group).select("_fine", F.lit(True).alias("_large"))
    group = F.when(F.col("_large"), F.concat(F.lit("source "), "_fine")).otherwise(F.concat(F.lit("pool "), "_pool"))
    fine = scratch.cut(fine)
    featured = with_estimates(counted, fine, ["_fine"], fine.count()).withColumn("group", group).select("*", *features())
    passed = featured.where("not base_failed").select("group", *NAMES)
    large = scratch.cut(passed.groupBy("group").count().where(F.col("count") >= least_group).select("group"))
    rows = scratch.cut(with_estimates(passed, large, ["group"], large.count(), "inner"))
    estimate = covariance_estimates(scratch, rows, **fit)
    n = estimate.count()
    scale = _distance(rows, estimate, ["group"], n).groupBy("group").agg((F.percentile_approx("d2", F.lit(0.5), F.lit(2000)) / CHI2_MEDIAN).alias("scale"))
    judged = scratch.cut(estimate.join(scale, "group"))
    measured = _distance(featured, judged, ["group"], n, "left")
    out = measured.withColumn("distance", F.when(~F.col("base_failed"), F.col("d2") / F.greatest(F.col("scale"), F.lit(1.0))))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_verdicts(spark, documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
