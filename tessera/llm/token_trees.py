"""Operator 3: token counts that follow edits.

A document's pre-tokens, some dozens to a leaf, carry a segment tree with the code points and the
tokens below every node. Trees are kept in a table of one row a document, with the text cut into
leaves, and each batch of edits makes the next version of that table. An edit descends by code points to
the first leaf that it can change, reads pre-tokens from there on until one ends where an old leaf
ends behind the edit, and replaces these leaves; sums change only on the paths above them. Other
leaves are neither decoded nor encoded. Documents without edits pass through the same tasks as Arrow
rows: a branch of their own would run whatever makes the trees a second time. The pattern of
pre-tokens looks ahead by one code point at most and never back, so this is exact.
"""

from __future__ import annotations

import base64
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, small_batches

LEAF = 64
#: Code points before an edit whose pre-tokens can still change.
CONTEXT = 2


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known(dict):
    """Tokens by pre-token, which fills itself: from `older`, or by encoding."""

    def __init__(self, encode, older: dict[str, int]):
        super().__init__()
        self.encode, self.older = encode, older

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece)
        self[piece] = n = len(self.encode(piece)) if n is None else n
        return n


class PieceCounter:
    """Tokens of pre-tokens; those used last are remembered, about twice `room` at most."""

    def __init__(self, path: str, pattern: str, room: int = 250_000):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.room, self.known = room, Known(self.encoding.encode_ordinary, {})

    def rest(self) -> None:
        """Between tasks remember short pieces only, which come again most."""
        short = {w: n for w, n in self.known.items() if len(w) <= 9}
        self.known = Known(self.encoding.encode_ordinary, {})
        self.known.update(short)

    def counts(self, pieces: list[str]) -> list[int]:
        if len(self.known) > self.room:
            older, self.known = self.known, Known(self.encoding.encode_ordinary, self.known)
            older.older = {}
        return list(map(self.known.__getitem__, pieces))


def worker_counter(path: str) -> PieceCounter:
    """One for each Python worker, shared by the tasks that follow each other there."""
    import public_tokenizers

    counters = sys.__dict__.setdefault("_tessera_counters", {})
    if path not in counters:
        counters[path] = PieceCounter(path, public_tokenizers.PATTERN)
    return counters[path]


def _heap(leaves: np.ndarray) -> np.ndarray:
    """Sums over a complete binary tree: node k has children 2k and 2k + 1, leaves at the end."""
    size = 1 << max(0, len(leaves) - 1).bit_length()
    out = np.zeros(2 * size, dtype=np.int64)
    out[size : size + len(leaves)] = leaves
    level = size
    while level > 1:
        below = out[level : 2 * level]
        level //= 2
        out[level : 2 * level] = below[0::2] + below[1::2]
    return out


def cut_leaves(pieces: list[str], counter: PieceCounter, leaf: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, code points and tokens of leaves of `leaf` pre-tokens; no pre-tokens make no leaf."""
    tokens, starts = counter.counts(pieces), range(0, len(pieces), leaf)
    texts = ["".join(pieces[k : k + leaf]) for k in starts]
    return texts, np.array(list(map(len, texts)), dtype=np.int64), np.array([sum(tokens[k : k + leaf]) for k in starts], dtype=np.int64)


class TokenTree:
    """Segment tree of one text: heaps of code points and tokens over its leaves.

    `leaves` are texts or numbers of leaves of a stored tree, which `stored` gives when one is needed.
    """

    def __init__(self, leaves: list, chars: np.ndarray, tokens: np.ndarray, stored=None):
        self.leaves, self.stored = leaves, stored
        self._grow(chars, tokens)

    def _grow(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens = _heap(chars), _heap(tokens)
        self.size = len(self.chars) // 2

    @classmethod
    def build(cls, text: str, counter: PieceCounter, leaf: int = LEAF) -> TokenTree:
        return cls(*cut_leaves(counter.pattern.findall(text), counter, leaf))

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaf_sums(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.leaves)
        return self.chars[self.size : self.size + n], self.tokens[self.size : self.size + n]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds code point `at` (the last that holds any, if none does) and its first code point."""
        node, start = 1, 0
        at = min(at, int(self.chars[1]) - 1)
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.size
        more_chars, more_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def _text(self, leaf: int) -> str:
        held = self.leaves[leaf]
        return held if isinstance(held, str) else self.stored(held)

    def edit(self, at: int, removed: int, inserted: str, counter: PieceCounter, leaf: int = LEAF) -> int:
        """Replace `removed` code points from `at` on; returns how many pre-tokens were encoded anew."""
        n = int(self.chars[1])
        at = max(0, min(at, n))
        end = min(n, at + max(0, removed))
        if not len(self.leaves):
            fresh = TokenTree.build(inserted, counter, leaf)
            self.leaves = fresh.leaves
            self._grow(*fresh.leaf_sums())
            return len(counter.pattern.findall(inserted))
        first, start = self.find(max(0, at - CONTEXT))
        last, stop, window = first, start, ""
        while last < len(self.leaves) and (last == first or stop < end):  # the leaves that the edit touches, one at least
            window += self._text(last)
            stop += int(self.chars[self.size + last])
            last += 1
        window = window[: at - start] + inserted + window[end - start :]
        ends = {len(window): last}  # where leaves behind the edit end
        certain = len(window.rstrip())
        pieces = counter.pattern.findall(window)
        position = sum(map(len, pieces))
        while last < len(self.leaves) and pieces and position >= certain:  # what follows may lengthen the rest
            position -= len(pieces.pop())
        while position not in ends or (position == 0 and window):
            match = counter.pattern.match(window, position)
            if last < len(self.leaves) and (match is None or match.end() >= certain):  # what follows may lengthen it
                window += self._text(last)
                last += 1
                ends[len(window)] = last
                certain = len(window.rstrip())
                continue
            if match is None:
                break
            pieces.append(match.group())
            position = match.end()
        self._splice(first, ends.get(position, last), *cut_leaves(pieces, counter, leaf))
        return len(pieces)

    def _splice(self, first: int, last: int, leaves: list[str], chars: np.ndarray, tokens: np.ndarray) -> None:
        """New leaves in the place of first to last; with as many as before only the paths above them change."""
        if len(leaves) == last - first:
            self.leaves[first:last] = leaves
            for k, (c, t) in enumerate(zip(chars.tolist(), tokens.tolist(), strict=True)):
                self._set(first + k, c, t)
            return
        own = self.leaf_sums()
        self.leaves[first:last] = leaves
        self._grow(*(np.concatenate([o[:first], new, o[last:]]) for o, new in zip(own, (chars, tokens), strict=True)))


EDIT = "array<struct<at:long,removed:long,inserted:string>>"
#: A stored tree: its version, its leaves, and the code points and tokens of each.
TREE = {"version": "int", "n_tokens": "long", "leaves": "array<string>", "leaf_chars": "array<long>", "leaf_tokens": "array<long>"}
REPORT = {"tokens_before": "long", "reencoded": "long"}


def _fields(rows: DataFrame, keep: list[str], *more: dict[str, str]) -> str:
    own = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]
    return ", ".join(own + [f"{name} {kind}" for m in more for name, kind in m.items()])


def build_trees(docs: DataFrame, *, ranks: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` and the tree (TREE, version 0) of every row of `docs`, from its text.

    Null and empty texts have a tree without leaves and 0 tokens; very long texts have as many leaves
    as they need. Rows are independent, so repeated ids and equal texts have a tree each; an empty
    table gives an empty result; other columns are ignored.
    """
    path = ranks or ranks_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                yield _stored(batch, keep, [0] * batch.num_rows, [cut_leaves(counter.pattern.findall(t or ""), counter, LEAF) for t in batch.column("text").to_pylist()])
        counter.rest()

    return docs.select(*keep, "text").mapInArrow(run, _fields(docs, list(keep), TREE))


def _stored(batch: pa.RecordBatch, keep, versions: list[int], trees: list[tuple[list, np.ndarray, np.ndarray]], leaves: pa.Array | None = None, *more: pa.Array) -> pa.RecordBatch:
    """Trees as rows; `leaves` if given are their leaves, in the place of those in `trees`."""
    texts, chars, tokens = zip(*trees, strict=True) if trees else ((), (), ())
    arrays = [
        pa.array(versions, type=pa.int32()), pa.array([int(t.sum()) for t in tokens], type=pa.int64()), pa.array(texts, type=pa.list_(pa.string())) if leaves is None else leaves,
        pa.array(chars, type=pa.list_(pa.int64())), pa.array(tokens, type=pa.list_(pa.int64())),
    ]
    names = [*keep, *TREE, *(list(REPORT) if more else [])]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays, *more], names=names)


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_pylist()
    return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def apply_edits(trees: DataFrame, *, edits: str = "edits", ranks: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, the next version of every tree, tokens_before and reencoded, for stored trees with a column of edits.

    `edits` is an array of at, removed, inserted, in code points, applied in turn, each to the
    text that the last one left. Places beyond the text mean its end; null edits, and null parts
    of them, change nothing. `reencoded` counts all pre-tokens that were encoded. Trees with no
    edits keep their version and pass by, unread. Repeated ids are rows of their own; an empty table
    gives an empty result; other columns are ignored.
    """
    path = ranks or ranks_path()
    small_batches(trees.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(path)
        for batch in batches:
            some = pc.greater(pc.fill_null(pc.list_value_length(batch.column("edits")), 0), 0)
            resting = batch.filter(pc.invert(some))
            if resting.num_rows:
                none = pa.array(np.zeros(resting.num_rows, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*[resting.column(c) for c in (*keep, *TREE)], resting.column("n_tokens"), none], names=[*keep, *TREE, *REPORT])
                batch = batch.filter(some)
            if not batch.num_rows:
                continue
            leaves = batch.column("leaves")
            texts, firsts = leaves.values, leaves.offsets.to_pylist()
            chars, tokens = _lists(batch.column("leaf_chars")), _lists(batch.column("leaf_tokens"))
            changed, again = [], []
            for k, own in enumerate(batch.column("edits").to_pylist()):
                tree = TokenTree(list(range(firsts[k], firsts[k + 1])), chars[k], tokens[k], stored=lambda i: texts[i].as_py())
                changed.append(tree)
                again.append(sum(tree.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "", counter) for e in own if e is not None))
            # Leaves that no edit touched are taken over by number, without becoming Python strings.
            fresh = [leaf for t in changed for leaf in t.leaves if isinstance(leaf, str)]
            pool, place, numbers = pa.concat_arrays([texts, pa.array(fresh, type=pa.string())]), len(texts), []
            for t in changed:
                for leaf in t.leaves:
                    numbers.append(place if isinstance(leaf, str) else leaf)
                    place += isinstance(leaf, str)
            ends = np.cumsum([0, *(len(t.leaves) for t in changed)]).astype(np.int32)
            kept_leaves = pa.ListArray.from_arrays(pa.array(ends), pool.take(pa.array(numbers, type=pa.int64())))
            versions = [v + 1 for v in batch.column("version").to_pylist()]
            yield _stored(batch, keep, versions, [(t.leaves, *t.leaf_sums()) for t in changed], kept_leaves, batch.column("n_tokens"), pa.array(again, type=pa.int64()))
        counter.rest()

    rows = trees.select(*keep, *TREE, F.col(edits).cast(EDIT).alias("edits"))
    return rows.mapInArrow(run, _fields(trees, list(keep), TREE, REPORT))


def text_of(leaves: str = "leaves"):
    """The text of a stored tree."""
    return F.array_join(F.col(leaves), "")


def with_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """`rows` (documents or stored trees) with the edits (doc_id, ordinal, at, removed, inserted) of each doc_id as an array, in order.

    Edits of one ordinal follow by place, then by what they remove and insert, so repeated ones are made each. Rows that share a doc_id
    all get its edits; a row or an edit without a doc_id matches nothing, and such a row has none.
    """
    listed = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "at", "removed", "inserted"))).alias("_e"))
    listed = listed.select("doc_id", F.transform("_e", lambda e: F.struct(e["at"].alias("at"), e["removed"].alias("removed"), e["inserted"].alias("inserted"))).alias("edits"))
    return rows.join(listed, "doc_id", "left")


def redaction_edits(text: str = "text"):
    """Two edits of any text: 16 code points at its third give way to a mark, and a line is added at its end."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    mark = F.struct(F.floor(n / 3).alias("at"), F.lit(16).cast("long").alias("removed"), F.lit("[redacted]").alias("inserted"))
    line = F.struct(F.lit(2**40).alias("at"), F.lit(0).cast("long").alias("removed"), F.lit("\n(reviewed)").alias("inserted"))
    return F.array(mark, line)


def review_edits(chars: str = "leaf_chars"):
    """Two edits of any stored text, found from its code points alone: eight of its middle give way to a name, and a word is added in front."""
    n = F.aggregate(F.col(chars), F.lit(0).cast("long"), lambda a, x: a + x)
    name = F.struct(F.floor(n / 2).alias("at"), F.lit(8).cast("long").alias("removed"), F.lit(" [name] ").alias("inserted"))
    word = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("removed"), F.lit("Reviewed: ").alias("inserted"))
    return F.array(name, word)


def op3_token_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, a first batch of edits, the trees stored, and a second batch applied to the stored ones."""
    docs = documents(spark, sf_dir)
    built = build_trees(docs.withColumn("edits", redaction_edits()), keep=("doc_id", "edits"))
    first = apply_edits(built, keep=("doc_id",))
    stored = Scratch(spark).cut(first.select("doc_id", *TREE, F.col("tokens_before").alias("built_tokens"), F.col("reencoded").alias("first_reencoded")))
    second = apply_edits(stored.withColumn("edits", review_edits()), keep=("doc_id", "built_tokens", "first_reencoded"))
    return second.select("doc_id", F.col("built_tokens").alias("n_tokens"), F.col("tokens_before").alias("edited_tokens"), "first_reencoded", F.col("n_tokens").alias("reviewed_tokens"), "reencoded", "version")
