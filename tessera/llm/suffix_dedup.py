"""Operator 5: repeated passages by a distributed merge sort of suffixes.

A byte goes if a 100-byte string over it also starts earlier. In every such string the 24 bytes
of least hash are its anchor, the first of them on a tie: equal strings have equal anchors at equal
places. Neighbouring strings with one anchor form a tile. So only suffixes that start at anchors
are sorted, and of these only those whose first 24 bytes occur twice (a count by hash; what it lets
through by chance, the sort tells apart).

Tasks sort their suffixes into runs, front-code them (common prefix with the one before, then the
rest), and send each range of the alphabet to one task, which merges the runs by a loser tree
that keeps every loser's common prefix with the winner and so compares bytes from there on.
Suffixes that share 24 bytes or more come out side by side; within such a group equal
strings are found byte for byte, and all but the earliest are marked. An anchor with very many
tiles would make too large a group: its strings are sorted each on their own, so that only equal ones meet.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, number_rows
from .packing import mix64

WINDOW, GRAM = 100, 24
#: First bytes of keys: suffixes from anchors, and whole strings of hot anchors.
SUFFIX, STRING = b"A", b"B"
#: A row of a text: its document, and which of the rows with that doc_id.
OWNER = ["doc_id", "_copy"]
#: In the number of a tile: where its first string starts, whether its anchor is hot, the anchor less that, and how many strings.
START_AT, HOT_AT, OFFSET_AT, LOW = 15, 14, 7, 127
REACH = WINDOW - GRAM + 1
#: Bytes that are looked at together; longer texts go by overlapping parts.
PART = 1 << 20
HASH_MASK = np.uint64((2**64 - 1) ^ (2**24 - 1))
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from every place on (by halves: 1, 2, 4, 8, 16, then 24)."""
    table = mix64(np.arange(1, 257, dtype=np.uint64))
    h = table[raw]
    for k, size in enumerate((1, 2, 4)):
        h = h[:-size] * FACTORS[k] + h[size:]
    eight, n = h, len(raw) - GRAM + 1
    sixteen = eight[:-8] * FACTORS[3] + eight[8:]
    return mix64(sixteen[:n] * FACTORS[4] + eight[16 : 16 + n])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return out if size == width else np.minimum(out[: len(values) - width + 1], out[width - size :])


def find_tiles(raw: np.ndarray, firsts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tiles of texts laid end to end: (hash of the anchor, text, first string's start in the text, anchor less start, strings).

    `firsts` has each text's first byte and, last, the end; `starts` what its first byte is in its
    document (parts of long ones).
    """
    if len(raw) < WINDOW:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty, empty, empty
    hashes = _gram_hashes(raw)
    least = _least((hashes & HASH_MASK) | np.arange(len(hashes), dtype=np.uint64), REACH)
    anchor = (least & ~HASH_MASK).astype(np.int64)
    owner = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))[: len(anchor)]
    whole = np.arange(len(anchor)) + WINDOW <= firsts[owner + 1]
    place = np.flatnonzero(whole)
    if not len(place):
        return find_tiles(raw[:0], firsts, starts)
    new = np.ones(len(place), dtype=bool)
    new[1:] = (anchor[place[1:]] != anchor[place[:-1]]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    at = place[first]
    count = np.diff(np.append(first, len(place)))
    text = owner[at]
    return hashes[anchor[at]], text, at - firsts[text] + starts[text], anchor[at] - at, count


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, whole or in overlapping parts, gathered up to about PART bytes: (rows, bytes, firsts, starts)."""
    rows, pieces, starts, held = [], [], [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text) - WINDOW + 1), PART - WINDOW + 1):
            piece = text[start : start + PART]
            if len(piece) < WINDOW:
                continue
            if held and held + len(piece) > PART:
                yield rows, np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum([0, *map(len, pieces)]), np.array(starts)
                rows, pieces, starts, held = [], [], [], 0
            rows.append(row)
            pieces.append(piece)
            starts.append(start)
            held += len(piece)
    if rows:
        yield rows, np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum([0, *map(len, pieces)]), np.array(starts)


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def tiles_of(docs: DataFrame) -> DataFrame:
    """gram, doc_id, _copy, tile (start, anchor less start, strings, in one number): a row for every tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                owners = [batch.column(c).to_numpy() for c in OWNER]
                for rows, raw, firsts, starts in _parts(_bytes(batch.column("text"))):
                    gram, text, start, offset, count = find_tiles(raw, firsts, starts)
                    row = np.array(rows)[text]
                    yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), *[pa.array(o[row]) for o in owners], pa.array((start << START_AT) | (offset << OFFSET_AT) | count)], names=["gram", *OWNER, "tile"])

    return docs.select(*OWNER, "text").mapInArrow(run, "gram long, doc_id long, _copy long, tile long")


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that it is `known` at least."""
    least = min(len(a), len(b))
    while known < least:
        x, y = a[known : known + 16], b[known : known + 16]
        if x != y:
            n = min(len(x), len(y))
            differs = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return known + n - (differs.bit_length() + 7) // 8
        known += 16
    return least


def front_code(keys: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(common prefixes with the key before, what follows them, their lengths) of sorted keys of up to 255 bytes."""
    shared = np.zeros(len(keys), dtype=np.uint8)
    width = max(1, *map(len, keys))
    sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
    for at in range(0, len(keys), 20_000):
        some = keys[max(0, at - 1) : at + 20_000]
        grid = np.frombuffer(b"".join([k.ljust(width, b"\0") for k in some]), dtype=np.uint8).reshape(len(some), width)
        differs = grid[1:] != grid[:-1]
        first = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        begin = at if at else 1
        both = np.minimum(sizes[begin : begin + len(first)], sizes[begin - 1 : begin - 1 + len(first)])
        shared[begin : begin + len(first)] = np.minimum(first, both)
    rest = [k[s:] for k, s in zip(keys, shared.tolist(), strict=True)]
    return shared, b"".join(rest), np.fromiter(map(len, rest), dtype=np.uint8, count=len(rest))


def decode(shared: np.ndarray, rest: bytes, lengths: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the key before, key) of each front-coded key."""
    key, at = b"", 0
    for s, n in zip(shared.tolist(), lengths.tolist(), strict=True):
        key = key[:s] + rest[at : at + n]
        at += n
        yield s, key


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes, int]]:
    """(common prefix with the key before, key, run) in order: a loser tree over runs that come front-coded.

    A loser keeps its common prefix with the winner that beat it. When the winner's run moves on,
    its next key's prefix with the one just given out is known from the run; of two keys the one
    with the longer prefix is the smaller, and only on a tie are bytes compared, from there on.
    """
    size = 1 << max(0, len(runs) - 1).bit_length()
    keys: list[bytes | None] = [None] * size
    shared = [0] * size
    losers = [-1] * size

    def advance(k: int) -> None:
        got = next(runs[k], None) if k < len(runs) else None
        shared[k], keys[k] = got if got else (-1, None)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser), both with prefixes to the same key; the loser's becomes that with the winner."""
        if shared[a] > shared[b]:
            return a, b
        if shared[a] < shared[b]:
            return b, a
        if shared[a] < 0:
            return a, b
        x, y = keys[a], keys[b]
        n = _common(x, y, shared[a])
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    for k in range(size):
        advance(k)
    level = list(range(size))
    node = size // 2
    while len(level) > 1:
        following = []
        for i in range(0, len(level), 2):
            winner, loser = play(level[i], level[i + 1])
            losers[node + i // 2] = loser
            following.append(winner)
        level = following
        node //= 2
    winner = level[0]
    while keys[winner] is not None:
        yield shared[winner], keys[winner], winner
        advance(winner)
        node = (size + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _keys(text: bytes, tile: int) -> Iterator[tuple[bytes, int]]:
    """(key, tile): the tile's bytes from its anchor on, those before it backwards, and how many these are; of a hot anchor every string."""
    start, offset, count = tile >> START_AT, (tile >> OFFSET_AT) & LOW, tile & LOW
    if (tile >> HOT_AT) & 1:
        for k in range(start, start + count):
            yield STRING + text[k : k + WINDOW], (k << START_AT) | (1 << HOT_AT) | 1
    else:
        anchor = start + offset
        yield SUFFIX + text[anchor : start + count + WINDOW - 1] + text[start:anchor][::-1] + bytes((offset,)), tile


def sampled_keys(rows: DataFrame, first: int = 1 + GRAM) -> DataFrame:
    """key: the first bytes of all keys of rows of text and tiles; an anchor's, so that no group is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys = [k[:first] for text, own in zip(_bytes(batch.column("text")), batch.column("tiles").to_pylist(), strict=True) for tile in own for k, _ in _keys(text, tile)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary())], names=["key"])

    return rows.select("text", "tiles").mapInArrow(run, "key binary")


def sorted_runs(rows: DataFrame, splitters: list[bytes], most: int) -> DataFrame:
    """bin, content: front-coded sorted runs of up to about `most` keys, cut at the splitters, for rows of doc_id, _copy, text, tiles.

    Keys that equal an earlier one of their run are settled at once: their strings, as
    arrays of (doc_id, _copy, start, strings), are the content of bins below 0.
    """

    def pack(keys: list[bytes], places: list[tuple[int, int, int]]) -> Iterator[tuple[int, bytes]]:
        order = sorted(range(len(keys)), key=lambda i: (keys[i], places[i]))
        ordered = [keys[i] for i in order]
        place = np.array(places, dtype=np.int64)[order]
        fresh = np.fromiter((x != y for x, y in zip(ordered, [None, *ordered[:-1]], strict=True)), dtype=bool, count=len(ordered))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(ordered)), 0))
        later = ~fresh & (place != place[first]).any(axis=1)
        if later.any():  # of equal keys of the run only the earliest travels; bins below 0 hold what is settled
            doc, copy, tile = place[later].T
            yield -1 - int(doc[0] % 1021), np.stack([doc, copy, tile >> START_AT, tile & LOW]).tobytes()
        keep = np.flatnonzero(fresh)
        ordered, place = [ordered[i] for i in keep.tolist()], place[keep]
        edges = [0, *(bisect.bisect_left(ordered, s) for s in splitters), len(ordered)]
        for number, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                shared, rest, lengths = front_code(ordered[a:b])
                head = np.array([b - a, len(rest)], dtype=np.int64).tobytes()
                yield number, head + shared.tobytes() + lengths.tobytes() + rest + np.ascontiguousarray(place[a:b].T).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, places = [], []

        def flush() -> Iterator[pa.RecordBatch]:
            for number, content in pack(keys, places):
                yield pa.RecordBatch.from_arrays([pa.array([number], type=pa.int32()), pa.array([content], type=pa.binary())], names=["bin", "content"])
            keys.clear(), places.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc, copy, text, own in zip(*(batch.column(c).to_pylist() for c in OWNER), _bytes(batch.column("text")), batch.column("tiles").to_pylist(), strict=True):
                    for tile in own:
                        for key, part in _keys(text, tile):
                            keys.append(key)
                            places.append((doc, copy, part))
                    if len(keys) >= most:
                        yield from flush()
        if keys:
            yield from flush()

    return rows.select(*OWNER, "text", "tiles").mapInArrow(run, "bin int, content binary")


class _Run:
    """A received run: its keys front-coded, its places as arrays."""

    def __init__(self, content: bytes):
        n, size = np.frombuffer(content, dtype=np.int64, count=2).tolist()
        self.shared = np.frombuffer(content, dtype=np.uint8, count=n, offset=16)
        self.lengths = np.frombuffer(content, dtype=np.uint8, count=n, offset=16 + n)
        self.rest = content[16 + 2 * n : 16 + 2 * n + size]
        self.places = np.frombuffer(content, dtype=np.uint8, offset=16 + 2 * n + size).view(np.int64).reshape(3, n)
        self.at = 0

    def keys(self) -> Iterator[tuple[int, bytes]]:
        return decode(self.shared, self.rest, self.lengths)

    def place(self) -> tuple[int, int, int]:
        """doc_id, copy and tile of the next key."""
        self.at += 1
        return tuple(self.places[:, self.at - 1].tolist())


def _later_strings(group: list[tuple[bytes, list[tuple[int, int, int]]]]) -> Iterator[tuple[int, int, int, int]]:
    """(doc, copy, first start, strings) of strings that start earlier elsewhere, in a group of one anchor or string."""
    distinct = []
    for key, places in group:
        earliest = min(places)
        for place in places:
            if place != earliest:
                yield *place[:2], place[2] >> START_AT, place[2] & LOW
        doc, copy, tile = earliest
        distinct.append((doc, copy, (tile >> START_AT) + ((tile >> OFFSET_AT) & LOW), tile, key))
    if len(distinct) == 1:
        return
    distinct.sort()
    seen: set[bytes] = set()
    for doc, copy, _, tile, key in distinct:
        offset, count, start = key[-1], tile & LOW, tile >> START_AT
        content = key[-1 - offset : -1][::-1] + key[1 : len(key) - 1 - offset]
        first = None
        for j in range(count):
            string = content[j : j + WINDOW]
            if string in seen:
                if first is None:
                    first = j
            else:
                seen.add(string)
                if first is not None:
                    yield doc, copy, start + first, j - first
                    first = None
        if first is not None:
            yield doc, copy, start + first, count - first


SPANS = [*OWNER, "start", "strings"]


def merged_strings(runs: DataFrame) -> DataFrame:
    """doc_id, _copy, start, strings: runs of strings that start earlier elsewhere. Bins are merged one after the other."""

    def merge(contents: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        held = [_Run(c) for c in contents]
        group: list[tuple[bytes, list[tuple[int, int, int]]]] = []
        for shared, key, k in merge_runs([r.keys() for r in held]):
            place = held[k].place()
            if group and shared == len(key) == len(group[-1][0]):
                group[-1][1].append(place)
                continue
            if group and (shared < 1 + GRAM or key[:1] == STRING):
                if len(group) > 1 or len(group[0][1]) > 1:
                    yield from _later_strings(group)
                group = []
            group.append((key, [place]))
        if group:
            yield from _later_strings(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans(contents: list[bytes]) -> Iterator[pa.RecordBatch]:
            found: list[tuple[int, int, int, int]] = []
            for x in merge(contents):
                found.append(x)
                if len(found) >= 50_000:
                    yield batch_of(found)
                    found = []
            if found:
                yield batch_of(found)

        def batch_of(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = np.array(found, dtype=np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=SPANS)

        current, contents = None, []
        for batch in batches:
            for place, content in zip(batch.column("bin").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if place < 0:
                    settled = np.frombuffer(content, dtype=np.int64).reshape(4, -1)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in settled], names=SPANS)
                    continue
                if place != current and contents:
                    yield from spans(contents)
                    contents = []
                current = place
                contents.append(content)
        if contents:
            yield from spans(contents)

    return runs.repartition("bin").sortWithinPartitions("bin").mapInArrow(run, "doc_id long, _copy long, start long, strings long")


def cut_spans(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, n_bytes, n_removed, n_spans, kept_sha256, kept_text, for rows of text and spans (start, strings).

    The hash is of the bytes that are left; the text leaves out those cut off from their character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[tuple] = []
                for text, spans in zip(_bytes(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                    text = text or b""
                    kept, done, removed, n = [], 0, 0, 0
                    for span in sorted((s["start"], s["strings"]) for s in spans or ()):
                        start, end = span[0], min(len(text), span[0] + span[1] + WINDOW - 1)
                        if start > done or (n == 0 and start >= done):
                            kept.append(text[done:start])
                            n += 1
                            removed += end - start
                        else:
                            removed += max(0, end - done)
                        done = max(done, end)
                    kept.append(text[done:])
                    rest = b"".join(kept)
                    out.append((len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], type=t) for t in types]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "text", "spans").mapInArrow(run, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def with_copies(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """`docs` with `_copy`: 0, but numbers in the order of the texts' SHA-256 where rows repeat a doc_id."""
    again = scratch.cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    first = F.lit(0).cast("long")
    if again.isEmpty():
        return docs.withColumn("_copy", first)
    rows = docs.join(again, "doc_id", "left_semi")
    numbered = scratch.cut(number_rows(scratch, rows, ["doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)], "_copy"))
    return docs.join(again, "doc_id", "left_anti").withColumn("_copy", first).unionByName(numbered)


def _repeated_tiles(scratch: Scratch, texts: DataFrame, hot_size: int, salts: int = 64) -> DataFrame:
    """doc_id, _copy, tile of the tiles whose anchor's bytes occur twice, by hash; marked if over `hot_size` tiles have that anchor.

    Anchors with over a thousandth of these tiles, so fewer than a thousand, are spread over
    `salts` keys each for the join.
    """
    tiles = tiles_of(texts)
    twice = scratch.cut(tiles.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    total = twice.agg(F.sum("n")).first()[0] or 0
    wide = F.col("n") > total / 1000
    own = tiles.join(F.broadcast(twice.where(wide).select("gram", F.lit(True).alias("wide"))), "gram", "left")
    own = own.withColumn("salt", F.when(F.col("wide"), F.pmod(F.xxhash64(*OWNER, "tile"), F.lit(salts))).otherwise(0).cast("int"))
    mark = F.when(F.col("n") > hot_size, F.lit(1 << HOT_AT)).otherwise(0)
    keys = twice.select("gram", mark.alias("mark"), F.explode(F.when(wide, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return scratch.cut(own.join(keys, ["gram", "salt"]).select(*OWNER, F.col("tile").bitwiseOR(F.col("mark").cast("long")).alias("tile")))


def _splitters(texts: DataFrame, repeated: DataFrame, bin_size: int, keys_a_bin: int = 8) -> list[bytes]:
    """Keys that cut the order into bins of about `bin_size` keys, from those of a sample of documents that grows with the bins."""
    hot = F.when(F.col("tile").bitwiseAND(1 << HOT_AT) > 0, F.col("tile").bitwiseAND(LOW)).otherwise(1)
    n = repeated.agg(F.coalesce(F.sum(hot), F.lit(0))).first()[0]
    bins = max(-(-n // bin_size), min(n // 1000, texts.sparkSession.sparkContext.defaultParallelism * 4), 1)
    parts = 1_000_000
    share = min(parts, -(-keys_a_bin * bins * parts // max(1, n)))
    some = lambda df: df.where(F.pmod(F.xxhash64(*OWNER), F.lit(parts)) < share)
    listed = some(repeated).groupBy(*OWNER).agg(F.collect_list("tile").alias("tiles"))
    keys = sorted(sampled_keys(some(texts).join(listed, OWNER)).toArrow().column("key").to_pylist()) if bins > 1 else []
    return sorted({keys[len(keys) * k // bins] for k in range(1, bins)}) if keys else []


def _marked_spans(scratch: Scratch, texts: DataFrame, repeated: DataFrame, run_size: int, bin_size: int) -> DataFrame:
    """doc_id, _copy, spans: the runs of strings that start earlier, from the sort of the repeated tiles' keys."""
    splitters = _splitters(texts, repeated, bin_size)
    listed = repeated.groupBy(*OWNER).agg(F.collect_set("tile").alias("tiles"))
    spans = merged_strings(sorted_runs(texts.join(listed, OWNER), splitters, run_size))
    return scratch.cut(spans.groupBy(*OWNER).agg(F.collect_list(F.struct("start", "strings")).alias("spans")))


def remove_repeats(spark: SparkSession, docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), run_size: int = 150_000, bin_size: int = 60_000, hot_size: int = 20_000) -> DataFrame:
    """`keep` (doc_id among them), n_bytes, n_removed, n_spans, kept_sha256, kept_text, for every row of `docs` (doc_id, text).

    Every byte that a 100-byte string covers which also starts earlier - in a smaller doc_id, or
    before in the same text - goes; strings are those of the input, and never cross documents.
    Null text is empty; texts under 100 bytes stay whole; very long ones are read by overlapping
    parts. Rows that repeat a doc_id are documents of their own, in the order of their texts'
    SHA-256. Rows without a doc_id stay whole and remove nothing. An empty table gives an empty
    result; other columns are ignored. `run_size`, `bin_size` and `hot_size` (tiles of an anchor
    from which its strings are sorted one by one) shape the work and do not change the result.
    """
    scratch = Scratch(spark)
    rows = with_copies(scratch, docs.select(*keep, "text"))
    texts = rows.where("doc_id is not null and text is not null").select(*OWNER, "text")
    repeated = _repeated_tiles(scratch, texts, hot_size)
    spans = _marked_spans(scratch, texts, repeated, run_size, bin_size)
    scratch.free(repeated)
    return cut_spans(rows.join(spans, OWNER, "left"), list(keep))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, documents(spark, sf_dir)).drop("kept_text")
