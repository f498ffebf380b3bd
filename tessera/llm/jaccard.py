"""Operator 10: n-gram Jaccard join by chosen paths.

Each text is the set of its five-word shingles, and has a signature of minimum hashes. A run puts
a document into a bucket for each coordinate of its signature that the bucket's random choice
picks, 1 / similarity of them on average, so that two documents at the threshold share a bucket
of each level with the odds of a critical branching process; buckets that are still large split
again in the same way, small ones are compared in full by two bits of every minimum, and runs
repeat until the recall is met. Pairs that pass form candidate groups, within which the shingle
sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, documents, with_estimates
from .links import connected_components, connected_members, deal_blocks, linked_members
from .packing import mix64

SIGNATURE = 128
SHINGLE = 5


def word_hashes(text):
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all rows, how many each row has); a shorter text is one shingle, an empty one none."""
    offsets = column.offsets.to_numpy()
    words = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    lengths = np.diff(offsets).astype(np.int64)
    n = len(words)
    mixed = mix64(words)
    code = np.zeros(n, dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        shifted = np.zeros(n, dtype=np.uint64)
        if n > k:
            shifted[: n - k] = mixed[k:]
        code = code * factor + shifted
    starts = np.cumsum(lengths) - lengths
    ends = np.repeat(starts + lengths, lengths)
    full = np.arange(n) + width <= ends
    for row in np.flatnonzero((lengths > 0) & (lengths < width)):
        first, value = starts[row], np.uint64(lengths[row])
        for w in mixed[first : first + lengths[row]]:
            value = np.uint64((int(value) * int(factor) + int(w)) & (2**64 - 1))
        code[first], full[first] = value, True
    counts = np.where(lengths >= width, lengths - width + 1, (lengths > 0).astype(np.int64))
    return mix64(code[full]), counts


def _minima(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows x SIGNATURE minimum hashes of the rows that have shingles."""
    rng = np.random.default_rng(5)
    factors = rng.integers(1, 2**32, size=SIGNATURE, dtype=np.uint32) | np.uint32(1)
    addends = rng.integers(0, 2**32, size=SIGNATURE, dtype=np.uint32)
    short = (codes >> np.uint64(32)).astype(np.uint32)
    starts = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(starts), SIGNATURE), dtype=np.uint32)
    for k in range(SIGNATURE):
        out[:, k] = np.minimum.reduceat(short * factors[k] + addends[k], starts)
    return out


def _sketch(minima: np.ndarray) -> np.ndarray:
    """Two bits of every minimum, 32 bytes a row."""
    two = (mix64(minima.astype(np.uint64)) & np.uint64(3)).astype(np.uint8).reshape(len(minima), -1, 4)
    return two[:, :, 0] | (two[:, :, 1] << 2) | (two[:, :, 2] << 4) | (two[:, :, 3] << 6)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (the words, as 128 bits), minima, sketch; documents without words have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                codes, counts = shingles(batch.column("words"))
                if not len(codes):
                    continue
                minima = _minima(codes, counts)
                some = pa.array(np.flatnonzero(counts > 0))
                kept = [batch.column(c).take(some) for c in ("doc_id", "k1", "k2")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array([m.tobytes() for m in minima], type=pa.binary()), pa.array([s.tobytes() for s in _sketch(minima)], type=pa.binary())],
                    names=["doc_id", "k1", "k2", "minima", "sketch"],
                )

    words = docs.select("doc_id", word_hashes(F.col("text")).alias("words"))
    keyed = words.select("doc_id", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), "words")
    return keyed.mapInArrow(run, "doc_id long, k1 long, k2 long, minima binary, sketch binary")


def choose_paths(rows: DataFrame, similarity: float, runs: int) -> DataFrame:
    """path, id: the buckets below each row's path (null: the roots of all runs) that its signature chooses."""
    odds = np.uint64(min(2**64 - 1, int(2**64 / (similarity * SIGNATURE))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.arange(SIGNATURE, dtype=np.uint64) << np.uint64(32)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), dtype=np.uint32).reshape(batch.num_rows, SIGNATURE)
                tokens = mix64(minima.astype(np.uint64) | places[None, :])
                ids = batch.column("id").to_numpy()
                paths = batch.column("path")
                roots = [mix64(np.full(batch.num_rows, r + 1, dtype=np.uint64)) for r in range(runs)] if paths.null_count else [paths.to_numpy().view(np.uint64)]
                for root in roots:
                    below = mix64(tokens ^ root[:, None])
                    row, column = np.nonzero(mix64(below ^ np.uint64(0x5851F42D4C957F2D)) < odds)
                    yield pa.RecordBatch.from_arrays([pa.array(below[row, column].view(np.int64)), pa.array(ids[row])], names=["path", "id"])

    return rows.select("path", "id", "minima").mapInArrow(run, "path long, id long")


def runs_for(similarity: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold has met with that probability, if every bucket had to split `depth` times."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def within_sketch(similarity: float, sigmas: float = 5.0):
    """Test of pairs of sketches by the two-bit cells that differ, with room for the estimate's error."""
    equal = similarity + (1 - similarity) / 4
    most = int(SIGNATURE * (1 - equal) + sigmas * math.sqrt(SIGNATURE * equal * (1 - equal)))
    low = np.uint64(0x5555555555555555)

    def test(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        differs = x ^ y
        return np.bitwise_count((differs | (differs >> np.uint64(1))) & low).sum(axis=1, dtype=np.int64) <= most

    return test


def within_jaccard(similarity: float, columns: int = 4096):
    """Adjacency by the shingle sets themselves: products of 0/1 matrices over the shingles that occur twice."""

    def adjacency(a: list[bytes], b: list[bytes] | None) -> np.ndarray:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in (a if b is None else a + b)]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.cumsum(times > 1) - 1
        shared = times[place] > 1
        owner, place = owner[shared], rank[place[shared]]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        n = len(a)
        common = np.zeros((n, n if b is None else len(b)), dtype=np.float32)
        for start in range(0, int(rank[-1]) + 1 if len(rank) else 0, columns):
            lo, hi = np.searchsorted(place, [start, start + columns])
            dense = np.zeros((len(sets), columns), dtype=np.float32)
            dense[owner[lo:hi], place[lo:hi] - start] = 1
            common += dense[:n] @ (dense if b is None else dense[n:]).T
        common = common.astype(np.float64)
        total = sizes[:n][:, None] + (sizes[:n] if b is None else sizes[n:])[None, :] - common
        return common >= similarity * total - 1e-9

    return adjacency


def shingle_sets(rows: DataFrame) -> DataFrame:
    """`rows` with payload, the distinct shingles of their text, in its place."""
    others = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                codes, counts = shingles(batch.column("words"))
                parts = np.split(codes, np.cumsum(counts)[:-1])
                payload = pa.array([np.unique(p).tobytes() for p in parts], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), payload], names=[*others, "payload"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, word_hashes(F.col("text")).alias("words")).mapInArrow(run, f"{schema}, payload binary")


def candidate_buckets(scratch: Scratch, nodes: DataFrame, similarity: float, runs: int, bucket: int, depth: int) -> DataFrame:
    """key, id: the buckets with more than one member that all runs lead to.

    At each level the few paths over `bucket` are told apart first, and split again; what is
    counted and joined by path are the others, so that no hot path meets in a task.
    """
    rows = nodes.select(F.lit(None).cast("long").alias("path"), "id", "minima")
    done: DataFrame | None = None
    for level in range(1, depth + 1):
        chosen = scratch.cut(choose_paths(rows, similarity, runs))
        sizes = scratch.cut(chosen.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        large = scratch.cut(sizes.where(F.col("n") > bucket).select("path", F.lit(True).alias("large")))
        n_large = large.count()
        marked = with_estimates(chosen, large, ["path"], n_large)
        small = marked.where("large is null").select("path", "id").join(sizes.where(F.col("n") <= bucket).select("path"), "path")
        done = small if done is None else done.unionByName(small)
        split = marked.where("large").select("path", "id")
        if level == depth:
            done = done.unionByName(split)
        elif n_large:
            rows = split.join(nodes.select("id", "minima"), "id")
        else:
            break
    return done.select(F.col("path").alias("key"), "id")


def jaccard_join(spark: SparkSession, docs: DataFrame, *, similarity: float = 0.8, recall: float = 0.9999, bucket: int = 64, depth: int = 3) -> DataFrame:
    """doc_id, class_id, n_links for every row of `docs` (doc_id, text).

    Two rows link if the Jaccard similarity of their sets of five-word shingles is `similarity`
    or more; `n_links` counts the other rows linked with, class_id is the least doc_id that links
    lead to. Texts of fewer than five words are one shingle; null texts and texts without words
    link with nothing; very long ones are taken whole. Equal texts are one node, and links of each
    other, whatever their doc_ids; rows that repeat a doc_id are judged each by its own text. Rows
    without a doc_id come back with a null class. An empty table gives an empty result; other
    columns are ignored. `recall` is what the runs are planned for if every bucket had to split
    `depth` times; what they bring together is decided exactly.
    """
    scratch = Scratch(spark)
    keyed = docs.where("doc_id is not null").select("doc_id", "text")
    signed = scratch.cut(signatures(keyed))
    node = F.xxhash64("k1", "k2").alias("id")
    classes = scratch.cut(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight")).select(node, "k1", "first", "weight"))
    nodes = signed.select(node, "doc_id", "minima", "sketch").join(classes.select("id", F.col("first").alias("doc_id"), "weight"), ["id", "doc_id"]).dropDuplicates(["id"])
    nodes = scratch.cut(nodes.select("id", "weight", "minima", "sketch"))

    runs = runs_for(similarity, recall, depth)
    buckets = deal_blocks(scratch, candidate_buckets(scratch, nodes, similarity, runs, bucket, depth), 1024)
    near = connected_members(buckets.join(nodes.select("id", F.col("sketch").alias("payload")), "id"), within_sketch(similarity))
    candidates = scratch.cut(connected_components(scratch, near))

    grouped = candidates.join(nodes.select("id", "weight"), "id").select(F.col("component").alias("key"), "id", "weight")
    wanted = classes.join(grouped.select("id"), "id").select("id", "k1", F.col("first").alias("doc_id"))
    texts = keyed.join(wanted, "doc_id").where(F.xxhash64(word_hashes(F.col("text"))) == F.col("k1")).dropDuplicates(["id"])
    exact = scratch.cut(linked_members(shingle_sets(deal_blocks(scratch, grouped, 512).join(texts.select("id", "text"), "id")), within_jaccard(similarity)))
    links = exact.groupBy("id").agg(F.sum("links").alias("links"))
    components = scratch.cut(connected_components(scratch, exact.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    least = components.join(classes.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("class_id"))
    known = classes.join(links, "id", "left").join(components.join(least, "component").select("id", "class_id"), "id", "left")
    known = known.select("id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("class_id", "first").alias("class_id"))
    member = signed.select("doc_id", node).join(known, "id").select("doc_id", "class_id", "n_links")
    wordless = ~F.coalesce(F.regexp_like("text", F.lit(WORD)), F.lit(False))
    rest = docs.where(F.col("doc_id").isNull() | wordless).select("doc_id")
    return member.unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark, documents(spark, sf_dir))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
     s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
     e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p WHERE c >= 0.8 * (n + m - c) - 1e-9),
     r AS (SELECT doc_id AS s, doc_id AS t FROM documents UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a),
     c AS (SELECT s, min(t) AS c FROM r GROUP BY s),
     n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT doc_id, c.c AS class_id, coalesce(n.n, 0) AS n_links FROM documents JOIN c ON c.s = doc_id LEFT JOIN n ON n.a = doc_id
"""
