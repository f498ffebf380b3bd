"""Links within groups, taken block against block, and the components that links form.

A group's members never meet in one task once they are more than a block: every pair of blocks
is a task's group of its own. What leaves a task is, for each member, how many it links with and one
edge of a spanning forest - never the pairs, whose number grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_estimates


def _forest(adjacent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least id that each row and column reaches, by spreading least ids until nothing changes."""
    top = np.iinfo(np.int64).max
    rows, columns = a.copy(), b.copy()
    while True:
        more_rows = np.minimum(rows, np.where(adjacent, columns[None, :], top).min(axis=1, initial=top))
        more_columns = np.minimum(columns, np.where(adjacent, more_rows[:, None], top).min(axis=0, initial=top))
        if (more_rows == rows).all() and (more_columns == columns).all():
            return rows, columns
        rows, columns = more_rows, more_columns


def _linked(group: pa.Table, adjacency: Callable) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, least ids reached, weight of the members linked with) of one group; only members with a link."""
    ids = group.column("id").to_numpy()
    weights = group.column("weight").to_numpy()
    payload = group.column("payload").to_pylist()
    second = group.column("second").to_numpy(zero_copy_only=False).astype(bool)
    within = not second.any() or second.all()
    left = np.arange(len(ids)) if within else np.flatnonzero(~second)
    right = left if within else np.flatnonzero(second)
    adjacent = adjacency([payload[i] for i in left], None if within else [payload[i] for i in right])
    if within:
        if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
            return  # the other block is empty, and pairs of this one belong to its own group
        np.fill_diagonal(adjacent, False)
    rows, columns = _forest(adjacent, ids[left], ids[right])
    for at, reached, weight in ((left, rows, adjacent @ weights[right]), *(() if within else ((right, columns, adjacent.T @ weights[left]),))):
        some = weight > 0
        yield ids[at][some], reached[some], weight[some]


def deal_blocks(scratch: Scratch, members: DataFrame, block: int) -> DataFrame:
    """`members` (key, id and more) with lo, hi, second: the pairs of blocks that a member takes part in, one alone in a group of up to `block`.

    Only keys with more than `block` members are looked up, so no task sees a hot key whole.
    """
    large = scratch.cut(members.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > block))
    dealt = with_estimates(members, large, ["key"], large.count()).withColumn("_blocks", F.ceil(F.coalesce("_n", F.lit(1)) / block).cast("int"))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    places = [F.least("_own", "_other").alias("lo"), F.greatest("_own", "_other").alias("hi"), (F.col("_own") > F.col("_other")).alias("second")]
    return dealt.select(*members.columns, *places)


class Forest:
    """Union-find over row numbers, many pairs at a time."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        while True:
            above = self.parent[self.parent]
            if (above == self.parent).all():
                return self.parent[rows]
            self.parent = above

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def pairs_within(sizes: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i < j) of all pairs of rows of one group, about `most` at a time, for groups that lie one after the other."""
    after = np.repeat(np.cumsum(sizes), sizes) - np.arange(int(sizes.sum())) - 1
    total = np.cumsum(after)
    start = 0
    while start < len(after):
        done = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, done + most, side="right")))
        n = after[start:end]
        i = np.repeat(np.arange(start, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i, j
        start = end


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], rows: int = 1 << 15) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, sizes of its groups): rows in the order of `keys`, gathered to about `rows`, never with a part of a group."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        table = pa.Table.from_batches(held).combine_chunks()
        marks = np.stack([table.column(k).to_numpy() for k in keys])
        edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        end = table.num_rows if last else (int(edges[-1]) if len(edges) else 0)
        held.clear()
        if end < table.num_rows:
            held.extend(table.slice(end).to_batches())
        if end:
            inside = edges[edges < end]
            yield table.slice(0, end), np.diff(np.concatenate([[0], inside, [end]]))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from cut(False)
    if held:
        yield from cut(True)


def fixed_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Binary values of one length as rows of unsigned 64-bit numbers."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype=np.uint64).reshape(len(values), -1)


def crossing(table: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs belong to their group: all of one block, and of two blocks those across."""
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    second = table.column("second").to_numpy(zero_copy_only=False).astype(bool)
    return (lo[i] == hi[i]) | (second[i] != second[j])


def connected_members(dealt: DataFrame, test: Callable) -> DataFrame:
    """a, b: edges that connect the members of a group as its links do, at most one a member.

    `dealt`: key, lo, hi, second, id, payload (binary, of one length); `test(x, y)` says of two
    arrays of payloads, as rows of 64-bit numbers, which pairs link. Small groups are compared together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in whole_groups(batches, ("key", "lo", "hi")):
            payload, ids = fixed_rows(table.column("payload")), table.column("id").to_numpy()
            forest = Forest(len(ids))
            for i, j in pairs_within(sizes):
                linked = crossing(table, i, j)
                linked[linked] = test(payload[i[linked]], payload[j[linked]])
                forest.join(i[linked], j[linked])
            roots = forest.roots(np.arange(len(ids)))
            some = roots != np.arange(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(ids[roots[some]])], names=["a", "b"])

    placed = dealt.select("key", "lo", "hi", "second", "id", "payload").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return placed.mapInArrow(run, "a long, b long")


def linked_members(dealt: DataFrame, adjacency: Callable) -> DataFrame:
    """id, root, links: one row for each member and pair of blocks in which it has a link.

    `dealt`: key, lo, hi, second, id, weight (long, positive), payload (binary). `adjacency(a, b)`
    gives, for two lists of payloads, a boolean matrix of links; `b` None means within `a`.
    `links` sums the weights of the members linked with, `root` is the least id reached within the pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                parts = [np.concatenate(x) for x in zip(*out, strict=True)]
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], names=["id", "root", "links"])

        def close(group: pa.Table) -> None:
            if group.num_rows > 1:
                out.extend(_linked(group, adjacency))

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            if held:
                last = held[-1]
                same = all(last.column(c)[last.num_rows - 1].as_py() == batch.column(c)[0].as_py() for c in ("key", "lo", "hi"))
                if not same:
                    close(pa.Table.from_batches(held))
                    held.clear()
            edges = [0, *cuts.tolist(), batch.num_rows]
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                held.append(batch.slice(start, end - start))
                if end < batch.num_rows:
                    close(pa.Table.from_batches(held))
                    held.clear()
                    if len(out) > 500:
                        yield from flush()
        if held:
            close(pa.Table.from_batches(held))
        yield from flush()

    placed = dealt.select("key", "lo", "hi", "second", "id", "weight", "payload").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return placed.mapInArrow(run, "id long, root long, links long")


def connected_components(scratch: Scratch, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """id, component (its least id), for every id of `edges` (a, b), by alternating large and small stars.

    Each round is a few aggregates and joins, and their number grows with the logarithm of the
    longest path; it is an error if `most_rounds` do not end the search. Null ends are left out. Hot nodes are met by partial aggregates and split joins.
    """
    ends = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    ends = scratch.cut(ends)
    nodes = scratch.cut(ends.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    current = ends.where("u != v")
    state = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.cut(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = scratch.cut(small.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        scratch.free(current, large)
        current = small
        seen = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components not settled in {most_rounds} rounds")
    least = current.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(least.withColumnRenamed("u", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
