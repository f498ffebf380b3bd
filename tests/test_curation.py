import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import curation, splits


def test_exclusion_by_any_key(spark):
    rows = spark.createDataFrame([(1, "a", "X/1"), (2, "b", "x/2"), (3, "c", "file:9"), (4, "d", None), (5, None, "y")], "id long, h string, p string")
    prior = spark.createDataFrame([(1, None, None), (None, "b", None), (None, None, "FILE:9"), (None, None, "Y")], "id long, h string, p string")
    assert sorted(r.id for r in curation.exclude_prior(rows, prior, row_id="id", digest="h", path="p").collect()) == [3, 4]


def test_quartile_differs_from_ntile(spark):
    rows = spark.range(6)
    got = [r.q for r in rows.select("id", curation.quartile([F.lit(1)], ["id"]).alias("q")).orderBy("id").collect()]
    assert got == [min(3, i * 4 // 6) for i in range(6)]


def test_largest_remainder_sums_exactly(spark):
    for weights, target in (([1, 1, 1], 10), ([5, 3, 0, 2], 7), ([1], 3)):
        rows = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "k long, w long")
        got = {r.k: r.quota for r in curation.largest_remainder(rows, weight="w", target=target, tie=["k"]).collect()}
        assert sum(got.values()) == target
        assert all(abs(got[i] - target * w / sum(weights)) < 1 for i, w in enumerate(weights))


def greedy_loop(edges):
    used, out = set(), {}
    turns = {a: t for a, t, *_ in edges}
    for a in sorted(turns, key=turns.get):
        free = [(c, tie, r) for x, _, r, c, tie in edges if x == a and r not in used]
        if free:
            c, _, r = min(free)
            used.add(r)
            out[a] = r
    return out


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_greedy_match_equals_loop(spark, seed):
    rng = random.Random(seed)
    edges = [(a, a, 100 + r, float(rng.randrange(4)), rng.randrange(3)) for a in range(6) for r in range(5) if rng.random() < 0.8]
    if not edges:
        return
    got = curation.greedy_match(spark.createDataFrame(edges, "addition long, turn long, removal long, cost double, tie long"))
    assert {r.addition: r.removal for r in got.collect()} == greedy_loop(edges)


def test_smooth_order_keeps_shares(spark):
    rows = spark.createDataFrame([(i, g) for i, g in enumerate("aaaaaabbbc" + "d" * 20)] + [(40, None)], "i long, g string").repartition(3)
    got = curation.smooth_order(rows, "g", ["i"]).orderBy("position").collect()
    assert [r.position for r in got] == list(range(31))
    names = [r.g for r in got]
    for g, n in (("a", 6), ("b", 3), ("c", 1), ("d", 20), (None, 1)):
        assert [r.i for r in got if r.g == g] == sorted(r.i for r in got if r.g == g)
        assert all(abs(names[:p].count(g) - n * p / 31) <= 1.5 for p in range(32))
    assert curation.smooth_order(rows.limit(0), "g", ["i"]).count() == 0


def test_faithful_relative_caps(spark):
    rows = spark.createDataFrame([(v, f"{v}-{f}", f"l{f % 3}") for v in range(10) for f in range(6)], "v long, f string, leaf string")
    counts = spark.createDataFrame([("l0", 5), ("l1", 0)], "leaf string, n long")
    got = curation.faithful_relative(rows, counts, video="v", fact="f", leaf="leaf", seed="1", cap=2, target=9).collect()
    assert len(got) == 9
    assert max(sum(r.v == v for r in got) for v in range(10)) <= 2
    assert len({(r.v, r.leaf) for r in got}) == 9
    assert not curation.faithful_relative(rows, counts, video="v", fact="f", leaf="leaf", seed="1", cap=2, target=0).collect()


@pytest.mark.parametrize(("current", "flying", "want"), [(796, 0, (2, 2)), (797, 0, (1, 2)), (799, 0, (1, 1)), (800, 0, (0, None)), (796, 1, (2, 2)), (796, 2, (2, None))])
def test_window_submission(spark, current, flying, want):
    a, b = curation.window_submission(F.lit(current), F.lit(flying), target=800, workers=2, cap=2)
    assert tuple(spark.range(1).select(a, b).first()) == want


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.integers(0, 6), min_size=1), st.data())
def test_leaf_targets_are_the_nearest(totals, data):
    n = sum(totals.values())
    main = data.draw(st.integers(0, n))
    evaluation = data.draw(st.integers(0, n - main))
    got = splits.leaf_targets(totals, main, evaluation)
    error = lambda counts: sum((x - totals[leaf] * s) ** 2 for leaf, row in counts.items() for x, s in zip(row, splits.SHARES, strict=True))
    best = {(0, 0): 0.0}
    for total in totals.values():
        following = {}
        for (m, e), cost in best.items():
            for a in range(total + 1):
                for b in range(total - a + 1):
                    more = sum((x - total * s) ** 2 for x, s in zip((a, b, total - a - b), splits.SHARES, strict=True))
                    key = (m + a, e + b)
                    following[key] = min(following.get(key, np.inf), cost + more)
        best = following
    assert all(sum(row) == totals[leaf] and min(row) >= 0 for leaf, row in got.items())
    assert sum(r[0] for r in got.values()) == main and sum(r[1] for r in got.values()) == evaluation
    assert error(got) == pytest.approx(best[main, evaluation])
    with pytest.raises(ValueError):
        splits.leaf_targets(totals, n + 1, 0)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 9), st.integers(0, 7), st.data())
def test_group_quotas_are_the_nearest(singles, doubles, data):
    n = singles + 2 * doubles
    a = data.draw(st.integers(0, n))
    rows = (a, b := data.draw(st.integers(0, n - a)), n - a - b)
    ways = [(x, y, doubles - x - y) for x in range(doubles + 1) for y in range(doubles - x + 1)]
    ways = [w for w in ways if all(0 <= 2 * d <= r for d, r in zip(w, rows, strict=True))]
    if not ways:
        with pytest.raises(ValueError):
            splits.group_quotas(singles, doubles, rows)
        return
    got = splits.group_quotas(singles, doubles, rows)
    assert tuple(s + 2 * d for s, d in got) == rows and sum(d for _, d in got) == doubles
    error = lambda w: sum((r - d - (singles + doubles) * r / n) ** 2 for r, d in zip(rows, w, strict=True)) if n else 0
    assert error([d for _, d in got]) == pytest.approx(min(map(error, ways)))
    with pytest.raises(ValueError):
        splits.group_quotas(singles, doubles, (n + 1, 0, 0))


def test_kinds_come_near_their_targets():
    rng = random.Random(2)
    kinds = {}
    for _ in range(400):
        kind = tuple(sorted(rng.choice("aaab" "ccde") for _ in range(rng.choice([1, 1, 2, 2, 3]))))
        kinds[kind] = kinds.get(kind, 0) + 1
    held = splits.kind_counts(kinds)
    assert {k: sum(v) for k, v in held.items()} == kinds
    sizes = {}
    for k, n in kinds.items():
        sizes[len(k)] = sizes.get(len(k), 0) + n
    for size, quota in splits.size_quotas(sizes).items():
        assert [sum(v[j] for k, v in held.items() if len(k) == size) for j in range(3)] == quota
    for leaf in "abcde":
        counts = [sum(v[j] * k.count(leaf) for k, v in held.items()) for j in range(3)]
        assert all(abs(c - s * sum(counts)) <= 2 for c, s in zip(counts, splits.SHARES, strict=True))


def test_groups_are_split_whole_and_by_seed(spark):
    rng = random.Random(4)
    rows = [(t, f"{t}-{i}", [rng.choice("abc") for _ in range(rng.randrange(0, 5))]) for t in ("x", "y", None) for i in range(200)] + [("x", "none", None), ("x", "part", ["a", None])]
    groups = spark.createDataFrame(rows, "task string, g string, leaves array<string>").withColumn("_rank", F.lit("mine"))
    one, two, other = (sorted(map(str, splits.split_groups(groups.repartition(n), task="task", group="g", seed=s).collect())) for n, s in ((3, 1), (7, 1), (3, 2)))
    assert one == two != other and len(one) == len(rows)
    split = {r.g: r.split for r in splits.split_groups(groups, task="task", group="g").collect()}
    assert set(split) == {g for _, g, _ in rows}
    for t in ("x", "y"):
        counts = [sum(len(own or ()) for task, g, own in rows if task == t and split[g] == name) for name in splits.SPLITS]
        assert all(abs(c - s * sum(counts)) <= 4 for c, s in zip(counts, splits.SHARES, strict=True))
    with pytest.raises(ValueError):
        splits.split_groups(groups, task="task", group="g", most_kinds=2)
    assert splits.split_groups(groups.limit(0), task="task", group="g").count() == 0


def test_orders_over_ranges_and_turns(spark):
    from tessera.operators import ordering

    rng = random.Random(7)
    rows = spark.createDataFrame([(i, rng.choice("abc")) for i in range(200)], "i long, g string").repartition(5)
    got = ordering.number_rows(rows, ["g", "i"]).collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.g, r.i))] == list(range(1, 201))
    turned = curation.interleave(rows, "g", ["i"]).orderBy("position").collect()
    assert [r.position for r in turned] == list(range(1, 201)) and [r.g for r in turned[:3]] == ["a", "b", "c"]
    seen = {}
    keys = []
    for r in turned:
        seen[r.g] = seen.get(r.g, 0) + 1
        keys.append((seen[r.g], r.g))
    assert keys == sorted(keys)


def plain_take(rows, total, most_preferred):
    """The loop: turns of labels, a fill, one pass that drops shared parents and digests, another fill."""

    def turns(some):
        groups = {}
        for r in sorted(some):
            groups.setdefault(r[1], []).append(r)
        out, labels = [], sorted(groups, key=lambda k: (groups[k][0], k))
        while labels:
            out += [groups[k].pop(0) for k in labels]
            labels = [k for k in labels if groups[k]]
        return out

    def unused(chosen):
        return [r for r in rows if r[2] not in {c[2] for c in chosen} and r[3] not in {c[3] for c in chosen}]

    chosen = turns([r for r in rows if r[4]])[:most_preferred] + turns([r for r in rows if not r[4]])[: total - most_preferred]
    chosen += turns(unused(chosen))[: total - len(chosen)]
    kept, parents, digests = [], set(), set()
    for r in chosen:
        if r[2] not in parents and r[3] not in digests:
            kept.append(r)
            parents.add(r[2])
            digests.add(r[3])
    kept += turns(unused(kept))[: total - len(kept)]
    return [r[0] for r in kept]


def test_take_with_fallback_equals_the_loop(spark):
    import random

    rng = random.Random(11)
    for n, parents, digests, total in ((3, 2, 2, 2), (60, 30, 40, 25), (80, 60, 25, 20), (50, 20, 200, 12)):
        rows = [(i, rng.choice("abc"), f"p{rng.randrange(parents)}", f"d{rng.randrange(digests)}", rng.random() < 0.4) for i in range(n)]
        if n == 3:  # the second row shares with both others, and goes
            rows = [(1, "a", "A", "x", False), (2, "a", "A", "y", False), (3, "a", "B", "y", False)]
        df = spark.createDataFrame(rows, "i long, l string, p string, d string, f boolean")
        take = lambda: curation.take_with_fallback(df, preferred=F.col("f"), label="l", parent="p", digest="d", order=["i"], total=total, most_preferred=total // 3)
        want = plain_take(rows, total, total // 3)
        if len(want) == total:
            assert [r.i for r in take().orderBy("position").collect()] == want
        else:
            with pytest.raises(ValueError):
                take()


def test_first_by_unique_keys_equals_the_loop(spark):
    import random

    rng = random.Random(12)
    rows = [(i, rng.choice([None, *range(40)]), rng.randrange(60)) for i in range(200)] + [(200 + i, i // 2, 1000 + (i + 1) // 2) for i in range(30)]
    kept, seen = [], (set(), set())
    for i, a, b in rows:
        if a not in seen[0] and b not in seen[1]:
            kept.append(i)
            seen[0].add(a)
            seen[1].add(b)
    df = spark.createDataFrame(rows, "i long, a long, b long")
    assert sorted(r.i for r in curation.first_by_unique_keys(df, ["a", "b"], "i").collect()) == kept


def test_nearest_match_by_loops_and_by_rings_equals_the_loop(spark):
    import random

    rng = random.Random(14)
    for wide in (5, 100_000):
        additions = [(rng.choice(["hot", "hot", "a", None]), i, rng.randrange(1000), rng.randrange(wide)) for i in range(70)]
        removals = [(rng.choice(["hot", "hot", "a", "b"]), 1000 + i, rng.randrange(wide)) for i in range(40)]
        want, free = [], {r[1]: r for r in removals}
        for key, a, _, at in sorted(additions, key=lambda r: (r[2], r[1])):
            best = min(((abs(r[2] - at), n) for n, r in free.items() if r[0] == key and key), default=None)
            if best:
                del free[best[1]]
                want.append((a, best[1], best[0]))
        left = spark.createDataFrame(additions, "k string, addition long, turn long, at long")
        right = spark.createDataFrame(removals, "k string, removal long, at long")
        for most in (10**6, 0):
            assert sorted(map(tuple, curation.nearest_match(left, right, ["k"], most=most, first_ring=2).collect())) == sorted(want)


def test_ten_thousand_kinds_keep_quotas_and_come_near_their_targets():
    import itertools
    import time

    rng = random.Random(15)
    kinds = {k: rng.choice([1, 2, 5, 400]) for k in rng.sample(list(itertools.combinations_with_replacement("abcdefghijklmnop", 5)), 10_000)}
    began = time.perf_counter()
    held = splits.kind_counts(kinds)
    assert time.perf_counter() - began < 60
    assert all(sum(held[k]) == n and min(held[k]) >= 0 for k, n in kinds.items())
    assert [sum(c[i] for c in held.values()) for i in range(3)] == splits.size_quotas({5: sum(kinds.values())})[5]
    totals = {leaf: sum(n * k.count(leaf) for k, n in kinds.items()) for leaf in "abcdefghijklmnop"}
    for leaf, total in totals.items():
        got = [sum(held[k][i] * k.count(leaf) for k in kinds) for i in range(3)]
        assert all(abs(g - total * s) <= 3 for g, s in zip(got, splits.SHARES, strict=True))
