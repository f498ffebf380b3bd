"""Operator 7: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations that make the signs of centred vectors as balanced and as faithful as they can be are
learned on a bounded sample. Their codes are cut into substrings, each the key of a table; vectors
that share a key are compared by all their bits. A pair that is near enough is owned by the first
table in which it shares a key; vectors with a pair of their own in a bucket come there once more
with the original vectors, which decide in double precision. So each pair is decided once, and
nothing else is compared by its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents
from .links import Forest, connected_components, crossing, deal_blocks, fixed_rows, pairs_within, whole_groups
from .packing import mix64

BITS = 64
#: Of so many rotations at most, a row of a table carries the bits.
CUT_ROTATIONS = 16


def learn_rotations(sample: np.ndarray, n: int, iterations: int = 30, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrices): `n` maps of the vectors to up to 64 signs, from principal axes and different starts."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(BITS, sample.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    basis = axes[:, ::-1][:, :bits]
    projected = centred @ basis
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(iterations):
            signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ projected)
            rotation = (u @ vt).T
        out.append(basis @ rotation)
    return mean, np.stack(out)


def pairs_at(sample: np.ndarray, threshold: float, basis: np.ndarray, most: int = 4096, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sample, and for each another at cosine `threshold`.

    Every other one differs by what two vectors of the sample differ by, the rest by a direction
    that the bits see in full.
    """
    rng = np.random.default_rng(seed)
    x = sample[rng.integers(len(sample), size=most)]
    away = rng.normal(size=(most, basis.shape[1])) @ basis.T
    away[::2] = (sample[rng.integers(len(sample), size=most)] - sample[rng.integers(len(sample), size=most)])[::2]
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    some = size[:, 0] > 1e-9
    return x[some], threshold * x[some] + math.sqrt(max(0.0, 1 - threshold * threshold)) * away[some] / size[some]


def differing_bits(x: np.ndarray, y: np.ndarray, mean: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """The share of bits in which each vector of `x` differs from that of `y`."""
    return sum((((x - mean) @ r >= 0) != ((y - mean) @ r >= 0)).mean(axis=1) for r in rotations) / len(rotations)


def table_plan(rows: int, bits: int, shares: np.ndarray, recall: float) -> tuple[int, int]:
    """(length of a substring, rotations): keys as selective as the table is large, and as many as recall asks for.

    `shares` has the share of differing bits of pairs at the threshold; recall is the mean over
    them. Where keys of that length take more than CUT_ROTATIONS rotations, shorter ones are
    taken if what they add in comparisons (some 300 cost as much as a table's row) is less than
    what they save in tables.
    """

    def rotations(length: int) -> int:
        missed = (1 - (1 - shares) ** length) ** (bits // length)
        low, high = 0, 1
        while np.mean(missed**high) > 1 - recall and high < 2**20:
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if np.mean(missed**middle) > 1 - recall else (low, middle)
        return high

    length = min(bits, max(6, min(30, math.ceil(math.log2(max(2, rows / 8))))))
    if rotations(length) > CUT_ROTATIONS:
        length = min(range(min(length, 6), length + 1), key=lambda n: rotations(n) * (bits // n) * (1 + rows / 2**n / 300))
    return length, rotations(length)


def all_pairs(n: int) -> Plan:
    """One table with one key, and no bits to tell a pair apart by."""
    return Plan(Tables(1, 1, 1), np.zeros(n), np.zeros((0, n, 1)), 64)


def plan_for(sample: np.ndarray, rows: int, threshold: float, recall: float, slack: float) -> Plan:
    """The plan for unit vectors like the sample: substrings' length, rotations, most differing bits of a candidate pair.

    The first plan takes the angles to be those before centring; centring widens them where
    vectors share a direction, so pairs made at the threshold are measured for the second. The
    cut is wide enough for all of them. Where a plan takes more tables than there are vectors (a few of them, or
    so few components that codes cannot tell them apart) each pair is decided instead, which is less work.
    """
    angle, bits = math.acos(threshold) / math.pi, min(BITS, sample.shape[1])
    substring, count = table_plan(rows, bits, np.array([angle]), recall)
    if count * (bits // substring) > rows:
        return all_pairs(sample.shape[1])
    mean, rotations = learn_rotations(sample, min(count, CUT_ROTATIONS))
    centred = sample - mean
    basis = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    x, y = pairs_at(sample, threshold, basis)
    shares = differing_bits(x, y, mean, rotations) if len(x) else np.array([angle])
    substring, count = table_plan(rows, bits, shares, recall)
    if count * (bits // substring) > rows:
        return all_pairs(sample.shape[1])
    if count > len(rotations):
        mean, rotations = learn_rotations(sample, count)
    rotations = rotations[:count]
    cut = rotations[:CUT_ROTATIONS]
    widest = differing_bits(x, y, mean, cut).max() if len(x) else 0.0
    return Plan(Tables(bits, substring, len(rotations)), mean, rotations, int(max(angle + slack, widest) * bits * len(cut) + 1e-6))


def _codes(vectors: np.ndarray, mean: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Rows x rotations x bits, as booleans."""
    centred = vectors - mean
    return np.stack([centred @ r >= 0 for r in rotations], axis=1)


class Tables:
    """Where the tables' keys lie in a row of codes, a 64-bit number for each rotation; table k is substring k % parts of rotation k // parts."""

    def __init__(self, bits: int, length: int, rotations: int):
        self.length, self.parts = length, max(1, bits // length)
        self.n = self.parts * rotations
        self.mask = np.uint64((1 << length) - 1)

    def keys(self, codes: np.ndarray, table: int) -> np.ndarray:
        return (codes[:, table // self.parts] >> np.uint64(self.length * (table % self.parts))) & self.mask

    def owned(self, differs: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Which pairs, of these differing bits, share no key in a table before their own."""
        out = np.ones(len(table), dtype=bool)
        for k in range(int(table.max(initial=0))):
            some = np.flatnonzero(out & (table > k))
            out[some[self.keys(differs[some], k) == 0]] = False
        return out


class Plan(NamedTuple):
    """How the vectors of one length are indexed; without rotations all of them share one bucket."""

    tables: Tables
    mean: np.ndarray
    rotations: np.ndarray
    most: int


def packed_codes(x: np.ndarray, mean: np.ndarray, rotations: np.ndarray) -> np.ndarray:
    """Rows x rotations: the bits of each as a 64-bit number."""
    if not len(rotations):
        return np.zeros((len(x), 1), dtype=np.uint64)
    codes = _codes(x, mean, rotations)
    return (codes * (np.uint64(1) << np.arange(codes.shape[2], dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def index_rows(vectors: DataFrame, plan: Plan) -> DataFrame:
    """key, tab, id, payload (codes): a row for every unit vector (id, embedding as bytes) and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                codes = packed_codes(fixed_rows(batch.column("embedding")).view(np.float64), plan.mean, plan.rotations)
                payload = pa.array([row.tobytes() for row in codes], type=pa.binary())
                for k in range(plan.tables.n):
                    keys = mix64(plan.tables.keys(codes, k) + np.uint64(k << 40)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), k, dtype=np.int32)), batch.column("id"), payload], names=["key", "tab", "id", "payload"])

    return vectors.mapInArrow(run, "key long, tab int, id long, payload binary")


def _candidates(table: pa.Table, sizes: np.ndarray, plan: Plan, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a bucket whose codes are near enough, and which this bucket's table owns."""
    codes, tab = fixed_rows(table.column("payload")), table.column("tab").to_numpy()
    near = codes[:, :CUT_ROTATIONS]
    for i, j in pairs_within(sizes, most):
        distance = np.bitwise_count(near[i] ^ near[j]).sum(axis=1, dtype=np.int64)
        close = np.flatnonzero((distance <= plan.most) & crossing(table, i, j))
        i, j = i[close], j[close]
        own = plan.tables.owned(codes[i] ^ codes[j], tab[i])
        if own.any():
            yield i[own], j[own]


GROUP = ["key", "lo", "hi"]
BUCKET = [*GROUP, "second", "tab", "id", "payload"]


def with_own_pairs(dealt: DataFrame, plan: Plan) -> DataFrame:
    """The rows of `dealt` (BUCKET) that have a candidate pair which their bucket owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in whole_groups(batches, tuple(GROUP)):
            some = np.zeros(table.num_rows, dtype=bool)
            for i, j in _candidates(table, sizes, plan, 1 << 18):
                some[i] = some[j] = True
            if some.any():
                yield from table.filter(pa.array(some)).combine_chunks().to_batches()

    schema = "key long, lo int, hi int, second boolean, tab int, id long, payload binary"
    return dealt.select(*BUCKET).repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def decided(rows: DataFrame, plan: Plan, threshold: float) -> DataFrame:
    """id, root, links: for rows of BUCKET, weight and embedding, what each links with in its bucket's own pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, sizes in whole_groups(batches, tuple(GROUP), 1 << 13):
            x = fixed_rows(table.column("embedding")).view(np.float64)
            ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
            links, forest = np.zeros(len(ids), dtype=np.int64), Forest(len(ids))
            for i, j in _candidates(table, sizes, plan, max(1 << 10, (1 << 22) // x.shape[1])):
                linked = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
                i, j = i[linked], j[linked]
                links += (np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))).astype(np.int64)
                forest.join(i, j)
            some = links > 0
            roots = ids[forest.roots(np.arange(len(ids)))]
            yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (ids, roots, links)], names=["id", "root", "links"])

    placed = rows.select(*BUCKET, "weight", "embedding").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return placed.mapInArrow(run, "id long, root long, links long")


def unit_bytes(rows: DataFrame) -> DataFrame:
    """`rows` with embedding as the bytes of the unit vector in double precision."""
    others = [c for c in rows.columns if c != "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = (np.array(e, dtype=np.float64) for e in batch.column("embedding").to_pylist())
            payload = pa.array([(e / np.linalg.norm(e)).tobytes() for e in units], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), payload], names=[*others, "embedding"])

    return rows.mapInArrow(run, ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others) + ", embedding binary")


def links_of(scratch: Scratch, nodes: DataFrame, plan: Plan, threshold: float, block: int = 1024) -> DataFrame:
    """id, root, links of the unit vectors of one length (id, weight, embedding as bytes)."""
    dealt = deal_blocks(scratch, index_rows(nodes, plan), block)
    own = scratch.cut(with_own_pairs(dealt, plan))
    return scratch.cut(decided(own.join(nodes.select("id", "weight", "embedding"), "id"), plan, threshold))


def near_vectors(
    spark: SparkSession, vectors: DataFrame, *, threshold: float = 0.9, recall: float = 0.995, sample_rows: int = 10_000, slack: float = 0.1, whole: int = 0,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `vectors` (vec_id, embedding).

    Every row is indexed; rotations are learned on at most `sample_rows` vectors, those of least
    id hash. `recall` is what the tables are planned for at the threshold itself, by the bits in
    which pairs made at the threshold from the sample differ after centring; more similar pairs
    are found more surely. Vectors of one length are compared with each other, those of
    different lengths never link; of a length with up to `whole` vectors (none unless asked for) all pairs are decided.
    Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors
    are scaled by their greatest component first, so neither tiny nor huge ones under- or
    overflow. Vectors equal after that are one node, each a link of the others. Rows without
    vec_id are returned alone, without a component. A vec_id that repeats is one vector more for
    each row. An empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(spark)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    usable = F.coalesce(F.forall("e", finite) & F.exists("e", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("usable", usable)
    largest = F.array_max(F.transform("e", lambda x: F.abs(x)))
    scaled = rows.where("usable").select("vec_id", "e", largest.alias("top")).select("vec_id", F.transform("e", lambda x: x / F.col("top")).alias("e"))
    keyed = scaled.select("vec_id", "e", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(1), "e").alias("k2")).withColumn("id", F.xxhash64("k1", "k2"))
    classes = scratch.cut(keyed.groupBy("id").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first(F.size("e")).alias("n")))
    chosen = keyed.join(classes.select("id", F.col("first").alias("vec_id"), "weight", "n"), ["id", "vec_id"]).dropDuplicates(["id"])
    nodes = scratch.cut(unit_bytes(chosen.select("id", "weight", "n", F.col("e").alias("embedding"))))

    exact: DataFrame | None = None
    for n, count in sorted(map(tuple, nodes.groupBy("n").count().where("count > 1").collect())):
        own = nodes.where(F.col("n") == n)
        if count <= whole:
            plan = all_pairs(n)
        else:
            picked = own.orderBy(F.xxhash64("id")).limit(sample_rows).select("embedding").toArrow().column("embedding")
            plan = plan_for(fixed_rows(picked).view(np.float64), count, threshold, recall, slack)
        found = links_of(scratch, own, plan, threshold)
        exact = found if exact is None else exact.unionByName(found)
    if exact is None:
        exact = spark.createDataFrame([], "id long, root long, links long")
    links = exact.groupBy("id").agg(F.sum("links").alias("links"))
    components = scratch.cut(connected_components(scratch, exact.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    least = components.join(classes.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("component_id"))
    known = classes.join(links, "id", "left").join(components.join(least, "component").select("id", "component_id"), "id", "left")
    known = known.select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = keyed.select("vec_id", "id").join(known, "id").select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark, documents(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
     r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a),
     c AS (SELECT s, min(t) AS c FROM r GROUP BY s)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, vec_id = c.c AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.s = vec_id
"""
