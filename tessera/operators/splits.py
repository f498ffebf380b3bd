"""Splits of groups of rows, so that no group is parted and every leaf comes near its share of each split.

Groups with the same leaves are alike, so what has to be chosen is how many of each kind go to a
split: a table of kinds, whose size depends on the leaves and not on the rows. It is solved by
exact apportionment and by exchanges that lessen the squared error; the groups themselves are
then dealt by their rank within their kind, in joins.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import rank_within

SHARES = (0.6, 0.2, 0.2)
SPLITS = ("main", "eval", "test")


def apportion(total: int, weights: Sequence[float], caps: Sequence[int] | None = None) -> list[int]:
    """`total` units by weight, none above its cap, at least squared distance from the exact shares; ties to the first."""
    whole = sum(weights)
    exact = [total * w / whole if whole else total / len(weights) for w in weights]
    caps = [total] * len(exact) if caps is None else list(caps)
    out = [min(int(e + 1e-9), c) for e, c in zip(exact, caps, strict=True)]
    for _ in range(total - sum(out)):
        room = [k for k, (n, c) in enumerate(zip(out, caps, strict=True)) if n < c]
        if not room:
            raise ValueError("the caps hold less than the total")
        out[min(room, key=lambda k: (round(out[k] - exact[k], 9), k))] += 1
    return out


def _corner(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Some table with the given sums, filled from its first corner."""
    edges = np.unique(np.concatenate([[0], np.cumsum(rows), np.cumsum(columns)]))
    out = np.zeros((len(rows), len(columns)), dtype=np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        out[np.searchsorted(np.cumsum(rows), low, side="right"), np.searchsorted(np.cumsum(columns), low, side="right")] += high - low
    return out


def _near_shares(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A table with the given sums, within a few units of proportional."""
    whole = rows[:, None] * (columns[None, :] / max(1, columns.sum()))
    out = np.floor(whole + 1e-9).astype(np.int64)
    return out + _corner(rows - out.sum(axis=1), columns - out.sum(axis=0))


def leaf_targets(leaf_totals: dict[str, int], main_total: int, eval_total: int) -> dict[str, tuple[int, int, int]]:
    """(main, eval, test) of every leaf with the given sums, at the least squared distance from SHARES.

    Moving a row of a leaf from one split to another has a price; as long as a round of moves over
    two or three splits, which leaves all sums as they are, has a negative price, it is made. With
    convex prices no such round is left only at the optimum.
    """
    names = sorted(leaf_totals)
    totals = np.array([leaf_totals[n] for n in names], dtype=np.int64)
    columns = np.array([main_total, eval_total, totals.sum() - main_total - eval_total])
    if (columns < 0).any():
        raise ValueError("no leaf counts meet the totals")
    ideal = totals[:, None] * np.array(SHARES)
    table = _near_shares(totals, columns)
    rounds = [(0, 1), (0, 2), (1, 2), (0, 1, 2), (0, 2, 1)]
    while True:
        over = table - ideal

        def move(a: int, b: int, over=over) -> tuple[float, int]:
            prices = np.where(table[:, a] > 0, 2 * (over[:, b] - over[:, a]) + 2, np.inf)
            return float(prices.min()), int(prices.argmin())

        moves = [[(a, b, *move(a, b)) for a, b in zip(r, r[1:] + r[:1], strict=True)] for r in rounds]
        best = min(moves, key=lambda m: sum(x[2] for x in m))
        if sum(x[2] for x in best) >= -1e-9:
            return {n: tuple(map(int, row)) for n, row in zip(names, table, strict=True)}
        for a, b, _, leaf in best:
            table[leaf, a] -= 1
            table[leaf, b] += 1


def group_quotas(singles: int, doubles: int, rows: tuple[int, int, int]) -> tuple[tuple[int, int], ...]:
    """(groups of one row, groups of two) of each split that give its rows, nearest to proportional counts of groups.

    A split with r rows and d doubles has r - d groups, so being near in groups is being near in doubles.
    """
    if sum(rows) != singles + 2 * doubles:
        raise ValueError("rows do not add up")
    try:
        pairs = apportion(doubles, rows, [r // 2 for r in rows])
    except ValueError as error:
        raise ValueError("no split meets the rows") from error
    return tuple((r - 2 * d, d) for r, d in zip(rows, pairs, strict=True))


def size_quotas(sizes: dict[int, int], shares: Sequence[float] = SHARES) -> dict[int, list[int]]:
    """Groups of each size by split: larger sizes by share, smaller ones make up for the rows that they left uneven."""
    goal = apportion(sum(n * k for n, k in sizes.items()), shares)
    left, out = list(goal), {}
    for size in sorted(sizes, reverse=True):
        out[size] = apportion(sizes[size], [max(0, x) for x in left] if size == min(sizes) else shares)
        left = [x - size * n for x, n in zip(left, out[size], strict=True)]
    return out


def kind_counts(kinds: dict[tuple[str, ...], int]) -> dict[tuple[str, ...], list[int]]:
    """For each kind of group (its sorted leaves, and how many there are) how many go to each split.

    Sizes keep their quotas. From near-proportional counts the best exchange of two kinds of one
    size between two splits is made until none lessens the squared distance from the leaves' targets.
    """
    names = sorted(kinds)
    leaves = sorted({leaf for k in names for leaf in k})
    sizes: dict[int, int] = {}
    for k in names:
        sizes[len(k)] = sizes.get(len(k), 0) + kinds[k]
    quotas = size_quotas(sizes)
    vectors = np.array([[k.count(leaf) for leaf in leaves] for k in names], dtype=np.int64)
    held = np.zeros((len(names), len(SPLITS)), dtype=np.int64)
    members = {size: np.array([i for i, k in enumerate(names) if len(k) == size]) for size in sizes}
    for size, own in members.items():
        held[own] = _near_shares(np.array([kinds[names[i]] for i in own]), np.array(quotas[size]))
    rows = (held * np.array([len(k) for k in names])[:, None]).sum(axis=0)
    totals = {leaf: int(sum(kinds[k] * k.count(leaf) for k in names)) for leaf in leaves}
    wanted = leaf_targets(totals, int(rows[0]), int(rows[1]))
    target = np.array([wanted[leaf] for leaf in leaves]).T
    while True:
        gap = held.T @ vectors - target
        found = _exchange(vectors, held, gap, members, near=64) or _exchange(vectors, held, gap, members, near=None)
        if found is None:
            return {k: held[i].tolist() for i, k in enumerate(names)}
        p, q, a, b, n = found
        held[p, a] -= n
        held[p, b] += n
        held[q, b] -= n
        held[q, a] += n


def _exchange(vectors: np.ndarray, held: np.ndarray, gap: np.ndarray, members: dict[int, np.ndarray], near: int | None) -> tuple | None:
    """(p, q, a, b, n): the exchange of n groups of kind p in split a for n of kind q in b that lessens the squared distance most, or None.

    With d the difference of the kinds' leaves and g that of the splits' gaps, n exchanges change it by 2 n d.g + 2 n^2 d.d. With `near`
    only that many kinds are looked at on each side, those with most to gain on their own; None looks at all, block by block.
    """
    best = (0, None)
    for own in members.values():
        for a in range(len(SPLITS)):
            for b in range(len(SPLITS)):
                leave, join = own[held[own, a] > 0], own[held[own, b] > 0]
                if a == b or not len(leave) or not len(join):
                    continue
                pull = vectors @ (gap[a] - gap[b])
                leave, join = leave[np.argsort(-pull[leave], kind="stable")][:near], join[np.argsort(pull[join], kind="stable")][:near]
                # d.d is 1 at least, so nothing is gained where the pulls differ by no more
                leave = leave[pull[leave] - pull[join].min() > 1]
                for at in range(0, len(leave), 512):
                    some = leave[at : at + 512]
                    across = pull[join][None, :] - pull[some][:, None]
                    square = (vectors[some] ** 2).sum(axis=1)[:, None] + (vectors[join] ** 2).sum(axis=1)[None, :] - 2 * vectors[some] @ vectors[join].T
                    n = np.minimum(held[some, a][:, None], held[join, b][None, :])
                    n = np.clip(np.where(square > 0, -across // np.maximum(2 * square, 1), 1), 1, n)
                    price = np.where(square > 0, 2 * n * across + 2 * n * n * square, 0)
                    i, j = np.unravel_index(price.argmin(), price.shape)
                    if price[i, j] < best[0]:
                        best = (price[i, j], (some[i], join[j], a, b, n[i, j]))
    return best[1]


def split_groups(groups: DataFrame, *, task: str, group: str, seed: int = 0, most_kinds: int = 20_000) -> DataFrame:
    """task, group, split (main, eval, test) for groups of rows (`leaves`: the leaf of each row, any number of them).

    Each task is split on its own. Kinds of groups are counted first; more than `most_kinds` of a
    run are refused, as their table is worked out on the driver. Within a kind groups go by a
    seeded hash. Groups without rows take part as a kind of their own; null leaves are left out.
    """
    spark = groups.sparkSession
    kind = F.sort_array(F.filter(F.col("leaves"), lambda x: x.isNotNull()))
    rows = groups.select(F.col(task).alias("_task"), F.col(group).alias("_group"), F.coalesce(kind, F.array().cast("array<string>")).alias("_kind"))
    counted = rows.groupBy("_task", "_kind").count().limit(most_kinds + 1).collect()
    if len(counted) > most_kinds:
        raise ValueError(f"more than {most_kinds} kinds of groups")
    tasks: dict = {}
    for r in counted:
        tasks.setdefault(r["_task"], {})[tuple(r["_kind"])] = r["count"]
    ends = [(t, list(k), held[0], held[0] + held[1]) for t, kinds in tasks.items() for k, held in kind_counts(kinds).items()]
    limits = spark.createDataFrame(ends, f"_task {rows.schema['_task'].dataType.simpleString()}, _kind array<string>, _main long, _eval long")
    ranked = rank_within(rows, ["_task", "_kind"], F.xxhash64(F.lit(seed), "_group"), ["_group"], "_rank")
    same = ranked["_task"].eqNullSafe(limits["_task"]) & (ranked["_kind"] == limits["_kind"])
    dealt = ranked.join(F.broadcast(limits), same)
    split = F.when(F.col("_rank") <= F.col("_main"), SPLITS[0]).when(F.col("_rank") <= F.col("_eval"), SPLITS[1]).otherwise(SPLITS[2])
    return dealt.select(ranked["_task"].alias(task), F.col("_group").alias(group), split.alias("split"))
