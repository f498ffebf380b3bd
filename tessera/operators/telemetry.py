"""Telemetry: pairing of starts and ends, latencies, usage, cost, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import carried_in, cut, in_ranges, same_keys


def pair_calls(events: DataFrame, *, keys: list[str], order: list, start: Column, end: Column, at: str) -> DataFrame:
    """Ends with the start that each closes, first in first out within `keys`: started_at, ended_at, seconds; orphans have no start.

    An end is an orphan if no start is open: the running sum of starts less ends then falls to
    a new least value below zero. The n-th other end closes the n-th start. Sums and least sums are taken within ranges of (keys,
    order) and carried from range to range as the pair (sum, least running sum), so a key with most of the events has many tasks.
    Null keys are a key; the order must tell the events of a key apart.
    """
    kind = F.when(start, "s").when(end, "e")
    ranged = in_ranges(events.withColumn("_kind", kind).where("_kind is not null"), keys, order)
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    upto, before = within.rowsBetween(Window.unboundedPreceding, Window.currentRow), within.rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_sum", F.sum(F.when(F.col("_kind") == "s", 1).otherwise(-1)).over(upto)).withColumns({"_least": F.min("_sum").over(upto), "_last_least": F.min("_sum").over(before)})
    step = F.sum(F.when(F.col("_kind") == "s", 1).otherwise(-1))
    summed = carried_in(summed, keys, {"_total": step, "_low": F.min("_sum")}, {"_base": F.sum("_total"), "_floor": F.min(F.coalesce("_base", F.lit(0)) + F.col("_low"))})
    base = F.coalesce("_base", F.lit(0))
    orphans = lambda least: F.coalesce(F.greatest(F.lit(0), -F.least("_floor", base + F.col(least))), F.lit(0))
    fresh = (F.col("_kind") == "e") & (orphans("_least") > orphans("_last_least"))
    marked = summed.withColumn("_new", fresh).drop("_sum", "_least", "_last_least", "_base", "_floor")
    closes, opens = (F.col("_kind") == "e") & ~F.col("_new"), F.col("_kind") == "s"
    marked = marked.withColumns({"_s": F.count_if(opens).over(upto), "_e": F.count_if(closes).over(upto)})
    marked = carried_in(marked, keys, {"_ns": F.count_if(opens), "_ne": F.count_if(closes)}, {"_s0": F.sum("_ns"), "_e0": F.sum("_ne")})
    turn = F.when(opens, F.col("_s") + F.coalesce("_s0", F.lit(0))).when(closes, F.col("_e") + F.coalesce("_e0", F.lit(0)))
    marked = marked.withColumn("_turn", turn).drop("_s", "_e", "_s0", "_e0", "_range", "_new")
    starts = marked.where("_kind = 's'").select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_turn").alias("_of__turn"), F.col(at).alias("started_at"))
    ends = marked.where("_kind = 'e'").withColumnRenamed(at, "ended_at")
    seconds = F.expr("timestampdiff(MICROSECOND, started_at, ended_at)") / 1e6
    paired = ends.join(starts, same_keys(keys) & (F.col("_turn") == F.col("_of__turn")), "left").withColumn("seconds", seconds)
    return paired.drop("_kind", "_turn", "_of__turn", *[f"_of_{k}" for k in keys])


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, fractions: dict[str, float], *, most: int = 100_000, bins: int = 1024) -> DataFrame:
    """keys and a column for each of `fractions` (name to fraction): percentiles with linear interpolation, exact.

    Keys with up to `most` values are aggregated as they are. For the others, whose values would fill one
    buffer, the wanted ranks are narrowed down: a histogram of each interval that holds ranks, of `bins` bins, gives the bin of each rank, whose
    least and greatest values are the next interval, until both are one value. Every round moves
    histograms alone. Null and NaN values are left out; a key without values has no row.
    """
    values = cut(rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)"))
    few = [F.percentile("_v", F.lit(f)).alias(n) for n, f in fractions.items()]
    of = [F.col(k).alias(f"_of_{k}") for k in keys]
    sizes = values.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where(F.col("_n") > most)
    hot = cut(sizes)
    if hot.isEmpty():
        return values.groupBy(*keys).agg(*few)
    small = values.join(hot.select(*of), same_keys(keys), "left_anti").groupBy(*keys).agg(*few)
    values = values.join(hot.select(*of), same_keys(keys), "left_semi")
    ranks = F.array_distinct(F.array(*[r((F.col("_n") - 1) * f).cast("long") for f in fractions.values() for r in (F.floor, F.ceil)]))
    state, found = hot.select(*keys, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), ranks.alias("_ranks")), None
    while True:
        settled = state.where("_lo = _hi").select(*keys, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v"))
        found = settled if found is None else found.unionByName(settled)
        state = cut(state.where("_lo < _hi"))
        if state.isEmpty():
            break
        asked = state.select(*of, "_lo", "_hi", "_below", "_ranks")
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins))
        held = values.join(asked, same_keys(keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).withColumn("_bin", bin_)
        counted = held.groupBy(*keys, "_lo", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.any_value("_below").alias("_below"), F.any_value("_ranks").alias("_ranks"))
        earlier = F.sum("_c").over(Window.partitionBy(*keys, "_lo").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        counted = counted.withColumn("_first", F.col("_below") + F.coalesce(earlier, F.lit(0)))
        inside = F.filter("_ranks", lambda r: (r >= F.col("_first")) & (r < F.col("_first") + F.col("_c")))
        state = counted.withColumn("_ranks", inside).where("size(_ranks) > 0").select(*keys, F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), F.col("_first").alias("_below"), "_ranks")
    known = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    sized = known.join(hot.select(*of, "_n"), same_keys(keys))

    def between(fraction: float) -> Column:
        place = (F.col("_n") - 1) * fraction
        low, high = (F.col("_at")[r(place).cast("long")] for r in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    return small.unionByName(sized.select(*keys, *[between(f).alias(n) for n, f in fractions.items()]))


def latency_summary(paired: DataFrame, keys: list[str], *, most: int = 100_000) -> DataFrame:
    """n, mean, median, p90 (linear interpolation) and maximum of `seconds`, rounded to 6; keys without any have 0 and nulls."""
    r = lambda c, name: F.round(c, 6).alias(name)
    paired = cut(paired.select(*keys, "seconds"))
    sums = paired.groupBy(*keys).agg(F.count("seconds").alias("n"), r(F.avg("seconds"), "mean_s"), r(F.max("seconds"), "max_s"))
    ranked = exact_percentiles(paired, keys, "seconds", {"median_s": 0.5, "p90_s": 0.9}, most=most)
    ranked = ranked.select(*[F.col(k).alias(f"_of_{k}") for k in keys], r(F.col("median_s"), "median_s"), r(F.col("p90_s"), "p90_s"))
    return sums.join(ranked, same_keys(keys), "left").select(*keys, "n", "mean_s", "median_s", "p90_s", "max_s")


def unpaired_starts(events: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """open: starts less ends of each key, at least 0."""
    return events.groupBy(*keys).agg(F.greatest(F.lit(0), F.count_if(start) - F.count_if(end)).alias("open"))


def usage_by_role(events: DataFrame, role: str, fallback: str, sums: list[str]) -> DataFrame:
    """Sums of usage by role; a null or empty role counts for the node."""
    name = F.coalesce(F.nullif(F.col(role), F.lit("")), F.col(fallback)).alias("role")
    return events.groupBy(name).agg(F.count("*").alias("calls"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])


def call_cost(tokens_in: Column, cached: Column, out: Column, thought: Column, *, plain_rate: float, cached_rate: float, out_rate: float, usd_per_aud: float, gst: float) -> dict[str, Column]:
    """usd, aud, aud_with_gst of a sum of tokens; rates are by a million tokens, results rounded to 6 from exact values."""
    held = F.least(tokens_in, cached)
    usd = ((tokens_in - held) * plain_rate + held * cached_rate + (out + thought) * out_rate) / 1e6
    aud = usd / usd_per_aud
    return {"usd": F.round(usd, 6), "aud": F.round(aud, 6), "aud_with_gst": F.round(aud * (1 + gst), 6)}


def run_progress(events: DataFrame, *, item: str, at: str, done: Column) -> DataFrame:
    """items, done, first and last time, hours, items done an hour (null if no time has passed)."""
    hours = F.expr(f"timestampdiff(MICROSECOND, min({at}), max({at}))") / 3.6e9
    out = events.agg(F.count_distinct(item).alias("items"), F.count_if(done).alias("done"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.round(hours, 6).alias("hours"))
    return out.withColumn("per_hour", F.round(F.try_divide("done", "hours"), 6))


def session_delta(now: DataFrame, base: DataFrame, *, least_new: int = 10) -> DataFrame:
    """new_items since the base snapshot, hours, and a rate that is given only from `least_new` new items on."""
    both = now.crossJoin(base)  # one row each
    out = both.select((F.col("items") - F.col("base_items")).alias("new_items"), (F.expr("timestampdiff(MICROSECOND, base_at, at)") / 3.6e9).alias("hours"))
    return out.withColumn("per_hour", F.when(F.col("new_items") >= least_new, F.round(F.try_divide("new_items", "hours"), 6)))


def last_per_category(rows: DataFrame, category: list[str], order: str, n: int) -> DataFrame:
    """The last `n` rows of each category, in ascending order of `order` by `place`."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*category).orderBy(F.desc(order)))).where(F.col("_k") <= n)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*category).orderBy(order))).drop("_k")


def lease_reusable(state: Column, created: Column, expires: Column, now: Column, *, pending_minutes: int = 15, margin_minutes: int = 120) -> Column:
    """Active leases, and pending ones made less than `pending_minutes` ago, that last beyond the margin or for ever."""
    minutes = lambda a, b: F.timestamp_diff("MICROSECOND", a, b) / 6e7
    young = F.coalesce(minutes(created, now) < pending_minutes, F.lit(False))
    lasting = expires.isNull() | (minutes(now, expires) > margin_minutes)
    return F.coalesce(((state == "active") | ((state == "pending") & young)) & lasting, F.lit(False))
