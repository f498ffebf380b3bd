"""Curation: exclusion, deduplication, quotas, stratified and balanced selection, ordering.

All operators take and give DataFrames and stay on built-in functions. Where the order of rows
matters it is a column that the caller names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import carried_in, cut, in_ranges, number_rows, rank_in_ranges, same_keys, turn_positions


def stable_rank(*parts) -> Column:
    """Hash of the parts joined by `|`: the same order on every run and engine."""
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts]), 256)


def counts_by(df: DataFrame, *fields: str) -> DataFrame:
    """label (the fields joined by ` | `), n."""
    return df.groupBy(F.concat_ws(" | ", *[F.col(f).cast("string") for f in fields]).alias("label")).agg(F.count("*").alias("n"))


def exclude_prior(rows: DataFrame, prior: DataFrame, *, row_id: str, digest: str, path: str) -> DataFrame:
    """Rows that match no prior row by id, by digest, or by path (case ignored, `file:` paths apart)."""
    by_path = prior.select(F.lower(path).alias("_path")).where("_path is not null and not startswith(_path, 'file:')")
    out = rows.join(prior.select(row_id).where(F.col(row_id).isNotNull()), row_id, "left_anti")
    out = out.join(prior.select(digest).where(F.col(digest).isNotNull()), digest, "left_anti")
    return out.withColumn("_path", F.lower(path)).join(by_path, "_path", "left_anti").drop("_path")


def attribute_exclusions(rows: DataFrame, prior: DataFrame, *, row_id: str, digest: str, path: str) -> DataFrame:
    """reason (`id`, else `digest`, else `path`) and n: why rows are excluded, the first that holds."""
    ids = prior.select(F.col(row_id)).distinct().withColumn("_id", F.lit(True))
    digests = prior.select(F.col(digest)).distinct().withColumn("_digest", F.lit(True))
    paths = prior.select(F.lower(path).alias("_p")).distinct().withColumn("_by_path", F.lit(True))
    found = rows.withColumn("_p", F.lower(path)).join(ids, row_id, "left").join(digests, digest, "left").join(paths, "_p", "left")
    reason = F.when(F.col("_id"), "id").when(F.col("_digest"), "digest").when(F.col("_by_path"), "path")
    return found.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_group(rows: DataFrame, keys: list[str], order: list, k: int | Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def quartile(group: list[str], order: list) -> Column:
    """0 to 3: floor(4 * place / size), at most 3. Not `ntile`, whose groups differ when 4 does not divide the size."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return F.least(F.lit(3), F.floor(place * 4 / F.count("*").over(Window.partitionBy(*group)))).cast("int")


def round_robin(rows: DataFrame, label: str, order: list, best: str) -> DataFrame:
    """`position`: labels take turns, each giving its next row; labels go by their best value, then name.

    The order must tell a label's rows apart. A null label is one of its own, the first on ties.
    """
    ranked = rank_in_ranges(rows, [label], order, "_turn")
    least = ranked.groupBy(label).agg(F.min(best).alias("_best")).withColumnRenamed(label, f"_of_{label}")
    marked = ranked.join(least, same_keys([label])).drop(f"_of_{label}")
    return turn_positions(marked, "_turn", ["_best", label]).drop("_turn", "_best")


def sequence_batches(rows: DataFrame, group: list[str], order: list, batch: int) -> DataFrame:
    """sequence in its group from 1, batch from 0, turn (sequence mod 2), and a readable id."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    out = rows.withColumn("sequence", n)
    out = out.withColumn("batch", F.floor((F.col("sequence") - 1) / batch).cast("int")).withColumn("turn", F.col("sequence") % 2)
    return out.withColumn("readable_id", F.format_string("%s_%04d", F.concat_ws("_", *group), F.col("sequence")))


def interleave(rows: DataFrame, group: str, order: list) -> DataFrame:
    """`position` from 1: first rows of all groups, then second rows, groups by name."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return turn_positions(rows.withColumn("_turn", n), "_turn", [group]).drop("_turn")


def largest_remainder(groups: DataFrame, *, weight: str, target: int | Column, tie: list, partition: list[str] | None = None) -> DataFrame:
    """`quota`: target shared in proportion to the weights, exact in sum; what floors leave goes to the largest fractions, then by `tie`."""
    part = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(1))
    target = target if isinstance(target, Column) else F.lit(target)
    exact = (target * F.col(weight)).cast("decimal(38,12)") / F.sum(weight).over(part)
    out = groups.withColumn("_exact", exact.cast("double")).withColumn("_floor", F.floor("_exact").cast("long"))
    out = out.withColumn("_left", target - F.sum("_floor").over(part)).withColumn("_fraction", F.round(F.col("_exact") - F.col("_floor"), 9))
    rank = F.row_number().over(part.orderBy(F.desc("_fraction"), *tie))
    return out.withColumn("quota", F.col("_floor") + (rank <= F.col("_left")).cast("long")).drop("_exact", "_floor", "_left", "_fraction")


def stratified_sample(rows: DataFrame, strata: list[str], key: str, target: int, seed: str) -> DataFrame:
    """About proportional sample of exactly `target` rows (if there are as many), by stable hash within strata."""
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    quotas = largest_remainder(sizes, weight="_n", target=target, tie=[F.col(s) for s in strata])
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(stable_rank(F.lit(seed), F.col(key).cast("string")), key)))
    return ranked.join(quotas.select(*strata, "quota"), strata).where("_rank <= quota").drop("_rank", "quota")


def fixed_cell_targets(rows: DataFrame, targets: DataFrame, cells: list[str], order: list) -> DataFrame:
    """Rows chosen per cell up to its `target`; use `short_cells` to see cells that cannot meet theirs."""
    rank = F.row_number().over(Window.partitionBy(*cells).orderBy(*order))
    return rows.withColumn("_rank", rank).join(targets, cells).where("_rank <= target").drop("_rank", "target")


def short_cells(rows: DataFrame, targets: DataFrame, cells: list[str]) -> DataFrame:
    """Cells with fewer rows than their target, or rows but no target (problem `short` or `unexpected`)."""
    have = rows.groupBy(*cells).agg(F.count("*").alias("available"))
    both = have.join(targets, cells, "full")
    problem = F.when(F.col("target").isNull(), "unexpected").when(F.coalesce("available", F.lit(0)) < F.col("target"), "short")
    return both.select(*cells, F.coalesce("available", F.lit(0)).alias("available"), "target", problem.alias("problem")).where("problem is not null")


def faithful_relative(rows: DataFrame, counts: DataFrame, *, video: str, fact: str, leaf: str, seed: str, cap: int, target: int) -> DataFrame:
    """Rows chosen for leaves that have least so far: by (count of leaf, supply of leaf, hash); one a video and leaf, `cap` a video.

    A target of 0 gives no rows.
    """
    supply = rows.groupBy(leaf).agg(F.count("*").alias("_supply"))
    known = rows.join(supply, leaf).join(counts.select(leaf, F.col("n").alias("_have")), leaf, "left")
    order = [F.coalesce("_have", F.lit(0)), F.col("_supply"), stable_rank(F.col(video).cast("string"), F.col(fact).cast("string"), F.col(leaf).cast("string"), F.lit(seed)), F.col(fact)]
    ranked = known.withColumn("_order", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    first = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(video, leaf).orderBy("_order"))).where("_k = 1")
    capped = first.withColumn("_k", F.row_number().over(Window.partitionBy(video).orderBy("_order"))).where(F.col("_k") <= cap)
    return capped.orderBy("_order").limit(target).drop("_k", "_order", "_supply", "_have")


def distribution_shift(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    """shift_pp: the greatest change of a category's share, in percentage points."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        counted = df.groupBy(*fields).agg(F.count("*").alias("_n"))
        return counted.select(*fields, (F.col("_n") * 100.0 / F.sum("_n").over(Window.partitionBy(F.lit(1)))).alias(name))

    both = shares(before, "_a").join(shares(after, "_b"), fields, "full")
    gap = F.abs(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)))
    return both.agg(F.round(F.max(gap), 6).alias("shift_pp"))


def smooth_order(rows: DataFrame, group: str, order: list) -> DataFrame:
    """Rows with `position` from 0: groups spread evenly by their shares, within a group in the given order.

    Turn k of a group of n rows among N is due at (k - 1/2) N / n; rows stand in the order of
    what is due, on a tie by the group's name. A loop that always takes the group furthest behind
    its share gives each group the same number of rows and nearly the same places, but may swap
    neighbours; this order needs sorts alone. Null groups come first on ties; the order must
    tell the rows of a group apart.
    """
    name = F.col(group).cast("string")
    numbered = number_rows(rows.withColumn("_group", name), [F.col("_group").asc_nulls_first(), *order], "_place")
    groups = numbered.groupBy("_group").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    groups = groups.select(F.col("_group").alias("_of"), "_n", "_first")
    turned = numbered.join(groups, F.col("_group").eqNullSafe(F.col("_of"))).withColumn("_due", (2 * (F.col("_place") - F.col("_first")) + 1) / F.col("_n"))
    placed = number_rows(turned, ["_due", F.col("_group").asc_nulls_first()], "_position")
    return placed.withColumn("position", F.col("_position") - 1).drop("_group", "_of", "_place", "_n", "_first", "_due", "_position")


def greedy_match(edges: DataFrame, *, more=None, most_rounds: int = 1000) -> DataFrame:
    """addition, removal, cost: each addition in turn (`turn`) takes its cheapest removal still free (ties by `tie`, then removal).

    `edges`: addition, turn, removal, cost, tie. Rounds of proposals give the same result as the
    loop: every addition without a removal asks for the cheapest that has not refused it, and a
    removal holds on to the earliest that has asked. Every round is joins and aggregates. Edges need not be complete: `more(refused)` gives
    further ones, dearer than those before, of additions that all of theirs have refused, or None where there are none left.
    """
    want = F.struct("cost", "tie", "removal")
    edges = cut(edges)
    refused: DataFrame | None = None
    for number in range(1, most_rounds + 1):
        open_edges = edges if refused is None else edges.join(refused, ["addition", "removal"], "left_anti")
        asked = open_edges.groupBy("addition").agg(F.min(want).alias("w"), F.min("turn").alias("turn"))
        asked = asked.select("addition", "turn", "w.removal", "w.cost")
        held = asked.groupBy("removal").agg(F.min(F.struct("turn", "addition")).alias("h")).select("removal", F.col("h.addition").alias("holder"))
        both = cut(asked.join(held, "removal"))
        losers = both.where("addition != holder").select("addition", "removal")
        if losers.isEmpty():
            further = more(both.select("addition")) if more else None
            if further is None:
                return both.select("addition", "removal", "cost")
            edges = cut(edges.unionByName(further))
            continue
        refused = losers if refused is None else refused.unionByName(losers)
        refused = cut(refused) if number % 16 == 0 else refused  # losers come from a table that is cut already
    raise RuntimeError("matching did not settle")


def nearest_match(additions: DataFrame, removals: DataFrame, keys: list[str], *, most: int = 2_000, first_ring: int = 4) -> DataFrame:
    """addition, removal, cost: within equal keys each addition in turn takes the nearest removal still free (ties by removal).

    `additions`: keys, addition, turn, at; `removals`: keys, removal, at; places are whole numbers, the cost is their distance. An addition takes
    something while anything is free, so of a key's additions only the first take part, as many as
    it has removals. Keys with up to `most` removals run the loop in a task; in larger ones additions propose to removals by
    `greedy_match`, from a ring of neighbours in the order of places; only those that all of
    their ring have refused get a wider one, so the pairs looked at grow with the rows. Null keys match nothing.
    """
    supply = cut(removals.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("_supply")))
    ranked = rank_in_ranges(additions.select(*keys, "addition", "turn", "at"), keys, ["turn", "addition"], "_rank")
    asking = cut(ranked.join(supply, keys).where(F.col("_rank") <= F.col("_supply")).drop("_rank"))
    free = removals.select(*keys, "removal", "at").join(supply, keys)
    small, large = F.col("_supply") <= most, F.col("_supply") > most

    def loop(_, asked: pd.DataFrame, offered: pd.DataFrame) -> pd.DataFrame:
        offered = offered.sort_values("removal")
        at, names, out = offered["at"].to_numpy(), offered["removal"].to_numpy(), []
        for addition, place in asked.sort_values(["turn", "addition"])[["addition", "at"]].itertuples(index=False):
            k = int(np.argmin(np.abs(at - place)))  # the first of equals, so the least name
            out.append((addition, names[k], abs(int(at[k]) - place)))
            at, names = np.delete(at, k), np.delete(names, k)
        return pd.DataFrame(out, columns=["addition", "removal", "cost"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"addition {kind(additions, 'addition')}, removal {kind(removals, 'removal')}, cost long"
    local = asking.where(small).groupBy(*keys).cogroup(free.where(small).groupBy(*keys)).applyInPandas(loop, schema)
    if supply.where(large).isEmpty():
        return local
    return local.unionByName(_match_by_rings(asking.where(large), free.where(large), keys, first_ring).select("addition", "removal", F.col("cost").cast("long").alias("cost")))


def _match_by_rings(asking: DataFrame, free: DataFrame, keys: list[str], first_ring: int) -> DataFrame:
    """`nearest_match` of keys whose rows no task should hold."""
    index = cut(rank_in_ranges(free, keys, ["at", "removal"], "_place").select(*keys, "removal", F.col("at").alias("_to"), (F.col("_place") - 1).alias("_place")))
    both = asking.select(*keys, "at", F.lit(0).alias("_side"), "addition", "turn", "_supply").unionByName(free.select(*keys, "at", F.lit(1).alias("_side"), F.lit(None).alias("addition"), F.col("removal").cast("long").alias("turn"), "_supply"))
    ranged = in_ranges(both, keys, ["at", "_side", "turn", "addition"])
    upto = Window.partitionBy(*keys, "_range").orderBy("at", "_side", "turn", "addition").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = carried_in(ranged.withColumn("_here", F.count_if(F.col("_side") == 1).over(upto)), keys, {"_n": F.count_if(F.col("_side") == 1)}, {"_earlier": F.sum("_n")})
    placed = cut(ranged.where("_side = 0").select(*keys, "addition", "turn", "at", "_supply", (F.col("_here") + F.coalesce("_earlier", F.lit(0))).alias("_first")))

    def ring(some: DataFrame, width: int) -> DataFrame:
        """Edges to the neighbours up to `width` places on each side that are nearer than all beyond them."""
        low, high = F.greatest(F.col("_first") - width, F.lit(0)), F.least(F.col("_first") + width, F.col("_supply")) - 1
        near = some.withColumns({"_low": low, "_high": high}).withColumn("_place", F.explode(F.sequence("_low", "_high")))
        near = near.join(index, [*keys, "_place"]).withColumn("cost", F.abs(F.col("at") - F.col("_to")))
        edge = F.when((F.col("_place") == F.col("_low")) & (F.col("_low") > 0), F.col("cost"))
        edge = F.coalesce(edge, F.when((F.col("_place") == F.col("_high")) & (F.col("_high") < F.col("_supply") - 1), F.col("cost")))
        bound = near.groupBy("addition").agg(F.min(edge).alias("_bound"))
        sure = near.join(bound, "addition").where(F.col("_bound").isNull() | (F.col("cost") < F.col("_bound")))
        return sure.select("addition", "turn", "removal", "cost", F.lit(0).alias("tie"))

    most, state = asking.agg(F.max("_supply")).first()[0], {"width": first_ring, "told": None}

    def more(served: DataFrame) -> DataFrame | None:
        """A wider ring for those without a removal who have not been told of all removals yet."""
        waiting = placed.join(served.select("addition"), "addition", "left_anti")
        waiting = cut(waiting if state["told"] is None else waiting.join(state["told"], "addition", "left_anti"))
        if waiting.isEmpty():
            return None
        state["width"] = min(4 * state["width"], most)
        if state["width"] == most:
            told = waiting.select("addition")
            state["told"] = told if state["told"] is None else cut(state["told"].unionByName(told))
        return ring(waiting, state["width"])

    return greedy_match(ring(placed, first_ring), more=more)


def match_cost(aspect, duration, pixels, size, orientation) -> Column:
    """Cost of pairs (addition, removal) of columns: 10 if orientations differ, and weighted absolute logs of ratios."""
    gap = lambda pair, least: F.abs(F.log(F.greatest(pair[0], F.lit(least)) / F.greatest(pair[1], F.lit(least))))
    differs = F.when(orientation[0] != orientation[1], 10.0).otherwise(0.0)
    return differs + 3 * gap(aspect, 1e-9) + 1.5 * gap(duration, 0.25) + 0.35 * gap(pixels, 1.0) + 0.20 * gap(size, 1.0)


def window_submission(current: Column, in_flight: Column, *, target: int, workers: int, cap: int) -> tuple[Column, Column]:
    """(workers wanted, cap of the next submission or null): never more rows than the target can still take."""
    remaining = F.lit(target) - current
    wanted = F.when(remaining <= 0, 0).when(remaining >= workers * cap, workers).otherwise(1)
    limit = (
        F.when((remaining <= 0) | (in_flight >= wanted), F.lit(None))
        .when(wanted == 1, F.least(F.lit(cap), remaining))
        .when(remaining < (in_flight + 1) * cap, F.lit(None))
        .otherwise(F.lit(cap))
    )
    return wanted, limit.cast("int")


def first_by_unique_keys(rows: DataFrame, keys: list[str], order: str, *, most_rounds: int = 10_000) -> DataFrame:
    """Rows that a loop over `order` keeps if it drops each row that shares a key with one kept before; nulls are values.

    In a round every row that is the first of all its keys is kept, and what shares a key with it goes; the loop would do the
    same, since nothing before such a row can stop it. A row that goes keeps nothing else out, unlike
    deduplication by one key after another. `order` must tell rows apart.
    """
    shown = {f"_key{i}": F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for i, k in enumerate(keys)}
    still = cut(rows.select(F.col(order).alias("_at"), *[c.alias(n) for n, c in shown.items()]))
    kept: DataFrame | None = None
    for _ in range(most_rounds):
        first = None
        for n in shown:
            least = still.groupBy(n).agg(F.min("_at").alias("_at"))
            first = least.select("_at") if first is None else first.join(least.select("_at"), "_at", "left_semi")
        won = cut(still.join(first, "_at", "left_semi"))
        kept = won if kept is None else kept.unionByName(won)
        for n in shown:
            still = still.join(won.select(n), n, "left_anti")
        still = cut(still)
        if still.isEmpty():
            return rows.join(kept.select(F.col("_at").alias(order)), order, "left_semi")
    raise RuntimeError("unique keys did not settle")


def take_with_fallback(rows: DataFrame, *, preferred: Column, label: str, parent: str, digest: str, order: list, total: int, most_preferred: int) -> DataFrame:
    """Exactly `total` rows with `position` from 1: preferred ones up to `most_preferred`, then others, labels in turn, one a parent and digest.

    If there are too few, rows that share neither parent nor digest with those chosen follow. Of what was chosen, a row that
    shares a parent or digest with one kept before goes, and other rows that share neither with those kept take its place; these
    are not compared with each other. Every step takes rows by turns of labels. Fewer than `total` in the end is an error. The
    order must tell rows apart; null parents and digests are values, and a null `preferred` is no preference.
    """
    if not 0 <= most_preferred <= total:
        raise ValueError("most_preferred is a part of total")
    ranked = cut(number_rows(rows.withColumn("_preferred", F.coalesce(preferred, F.lit(False))), order, "_rank"))
    names = [parent, digest]

    def turns(some: DataFrame, most: int, after: int) -> DataFrame:
        placed = round_robin(some, label, ["_rank"], "_rank").where(F.col("position") <= most)
        return cut(placed.withColumn("_seq", F.col("position") + after).drop("position"))

    def unused(chosen: DataFrame) -> DataFrame:
        left = ranked
        for k in names:
            left = left.join(chosen.select(F.col(k).alias(f"_of_{k}")).distinct(), same_keys([k]), "left_anti")
        return left

    chosen = turns(ranked.where("_preferred"), most_preferred, 0)
    others = turns(ranked.where("not _preferred"), total - most_preferred, chosen.count())
    chosen = chosen.unionByName(others)
    have = chosen.count()
    if have < total:
        chosen = chosen.unionByName(turns(unused(chosen), total - have, have))
    kept = cut(first_by_unique_keys(chosen, names, "_seq"))
    have = kept.count()
    if have < total:
        kept = kept.unionByName(turns(unused(kept), total - have, 2 * total))
        have = kept.count()
    if have != total:
        raise ValueError(f"only {have} of {total} rows")
    return number_rows(kept, ["_seq"], "position").drop("_preferred", "_rank", "_seq")


def pending_first(rows: DataFrame, done: DataFrame, *, key: str, group: str, order: list, k: int) -> DataFrame:
    """Up to `k` rows of each group that are not done, in order."""
    return top_per_group(rows.join(done.select(key), key, "left_anti"), [group], order, k)


def fixed_windows(rows: DataFrame, sequence: str, size: int) -> DataFrame:
    """`window_no` from 0 of rows with a sequence from 1."""
    return rows.withColumn("window_no", F.floor((F.col(sequence) - 1) / size).cast("int"))


def under_root(path: Column, root: str) -> Column:
    """A path below a root, case and kind of slash ignored."""
    plain = lambda c: F.lower(F.translate(c, "\\", "/"))
    return F.startswith(plain(path), plain(F.lit(root.rstrip("/\\") + "/")))
