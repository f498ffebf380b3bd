"""Operator 6: packing along a space-filling curve.

Each document's token ids give a hashed vector, normalised and projected to a few dimensions by a
fixed orthogonal matrix; its Hilbert key orders the documents so that neighbours on the curve
are alike. Ranges of keys go to tasks, every task lays its documents end to end, and the tokens
before each range (one sum a range) turn places in it into places on the whole line, which is
cut every `capacity` tokens. Only the last sequence can need padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

DIMENSIONS, GRID_BITS, HASHED = 3, 10, 64
TIE_BITS = 62 - DIMENSIONS * GRID_BITS


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index along the Hilbert curve of each row of `cells` (n x dimensions, each below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations of each level
        low = q - 1
        for i in range(n):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def mix64(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def projection() -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(7).normal(size=(HASHED, DIMENSIONS)))[0]


#: With marks that combine, or letters whose lower case has such a mark or depends on its place,
#: letters do not turn to lower case one by one, and some controls part words in Python alone; such texts go to the tokenizer as they are.
UNUSUAL = re.compile("[\x1c-\x1f\u0130\u0300-\u036f\u03a3]")


def rank_encoder(path: str):
    """(encoder, ids by its ranks) of a byte-level tokenizer whose words end in `</w>`, for words of lower-case letters.

    The merges in their order are ranks, and the end of a word is a byte that no such word
    has. Ranks join pairs by what they spell, merges by their parts; where the two disagree on a
    sample of the vocabulary's own words there is no encoder.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    value = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    name = {b: c for c, b in value.items()}
    spelled = lambda t: bytes(value[c] for c in t.removesuffix("</w>")) + (b"\x01" if t.endswith("</w>") else b"")
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 1]): 256 + b for b in range(256)}
    ids = [model["vocab"][name[b]] for b in range(256)] + [model["vocab"][name[b] + "</w>"] for b in range(256)]
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        ranks[spelled(a) + spelled(b)] = len(ids)
        ids.append(model["vocab"][a + b])
    encoder = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
    table = np.array(ids, dtype="<u2")
    plain = [w for w in (t.removesuffix("</w>") for t in model["vocab"]) if w.isascii() and w.isalpha() and w.islower()]
    sample = plain[::7] + [a + b for a, b in zip(plain[::11], plain[5::11], strict=False)]
    want = Tokenizer.from_file(path).encode(" ".join(sample), add_special_tokens=False).ids
    got = table[np.array(encoder.encode_ordinary("\x01 ".join(sample) + "\x01"))]
    return (encoder, table) if got.tolist() == want else None


class WordEncoder:
    """Ids of texts by way of their words: this tokenizer drops white space and never joins over it.

    The ids of up to about twice `room` words are kept, those used last. New words that are
    letters, then perhaps stops, are encoded many at a time, as one text (by ranks, several times
    faster than by merges): each run of letters ends in the one token that closes a word, by
    which the ids are told apart.
    `special`: strings of special tokens in a text become those tokens, as is the library's default.
    """

    STOPS = ".,;:!?"

    def __init__(self, path: str, room: int = 300_000, special: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.room = room
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closes = np.zeros(65536, dtype=bool)
        self.ranked = rank_encoder(path)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def rest(self) -> None:
        """Between tasks remember short words only, which come again most."""
        self.known, self.older = {w: ids for w, ids in self.known.items() if len(w) <= 8}, {}

    def _plain(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        pending = iter(words)
        while some := list(islice(pending, 20_000)):
            out += [np.array(x.ids, dtype="<u2").tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            if self.ranked:
                encoder, table = self.ranked
                ids = table[np.array(encoder.encode_ordinary("\x01 ".join(some) + "\x01"), dtype=np.int64)] if some else table[:0]
            else:
                ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u2")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 2
            if len(ends) != len(some):
                out += self._plain(some)
                continue
            raw, start = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[start:end])
                start = end
        return out

    def _learn(self, words: set[str]) -> None:
        """Make all of `words` known: from what was known before, from their letters and stops, or anew."""
        older, known = self.older, self.known
        if older:
            again = words & older.keys()
            known.update(zip(again, map(older.__getitem__, again), strict=True))
            words = words - again
        letters = list(filter(str.isalpha, words))
        others = [w for w in words.difference(letters) if w]
        cores = [w.rstrip(self.STOPS) for w in others]
        stopped = [(w, c, w[len(c) :]) for w, c in zip(others, cores, strict=True) if c.isalpha()]
        letters += list({c for _, c, _ in stopped}.difference(known, letters))
        known.update(zip(letters, self._letters(letters), strict=True))
        tails = {t for _, _, t in stopped if t}
        plain = [w for w, c in zip(others, cores, strict=True) if not c.isalpha()] + list(tails.difference(known))
        known.update(zip(plain, self._plain(plain), strict=True))
        known.update([(w, known[c] + known[t]) for w, c, t in stopped])
        known[""] = b""

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        """Little-endian 16-bit ids of each text, each closed by `end`."""
        closing = np.array([end], dtype="<u2").tobytes()
        usual = [not UNUSUAL.search(t) for t in texts]
        split = [t.lower().split() if ok else () for t, ok in zip(texts, usual, strict=True)]
        if len(self.known) > self.room:
            self.older, self.known = self.known, {}
        self._learn(set().union(*split).difference(self.known))
        look = self.known.__getitem__
        return [(b"".join(map(look, words)) if ok else self._plain([t])[0]) + closing for t, words, ok in zip(texts, split, usual, strict=True)]


def worker_encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker: tasks that follow each other there share its words."""
    import sys

    encoders = sys.__dict__.setdefault("_tessera_encoders", {})
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def _vectors(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Each document's hashed, normalised id vector."""
    owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(flat))))
    hashed = mix64(np.arange(65536))
    cell = (hashed % np.uint64(HASHED)).astype(np.int64)
    sign = np.where((hashed >> np.uint64(32)) & np.uint64(1), 1.0, -1.0)
    out = np.bincount(owner * HASHED + cell[flat], weights=sign[flat], minlength=n * HASHED).reshape(n, HASHED)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, key (Hilbert key, then bits of the id's hash to split equal texts), n, ids."""
    basis = projection()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()], end)
                lengths = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                flat = np.frombuffer(b"".join(ids), dtype="<u2").astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                points = _vectors(flat, starts, len(ids)) @ basis
                cells = np.clip(((points + 1) / 2 * (1 << GRID_BITS)).astype(np.int64), 0, (1 << GRID_BITS) - 1)
                spread = batch.column("tie").to_numpy(zero_copy_only=False).astype(np.uint64) >> np.uint64(64 - TIE_BITS)
                key = (hilbert_key(cells, GRID_BITS) << TIE_BITS) | spread.astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key), pa.array(lengths), pa.array(ids, type=pa.binary())], names=["doc_id", "key", "n", "ids"])
        encoder.rest()

    return docs.select("doc_id", "text", F.xxhash64("doc_id").alias("tie")).mapInArrow(run, "doc_id long, key long, n long, ids binary")


def pack_documents(spark: SparkSession, docs: DataFrame, *, tokenizer: str | None = None, capacity: int = 4096, end: int = 2, rows_per_range: int = 4000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids (16-bit), ids_crc32, doc_tokens, sequence_id, offset.

    Null text is empty; an empty text is the end id alone; equal texts and repeated rows are
    packed each; a text of any length is cut where a sequence ends; an empty table gives no
    pieces; other columns are ignored. All but the last sequence are full.
    """
    path = tokenizer or tokenizer_path()
    scratch = Scratch(spark)
    coded = scratch.cut(encoded(docs, path, end))
    rows = coded.count()
    ranges = max(1, min(10_000, rows // rows_per_range))
    probabilities = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(coded.agg(F.percentile_approx("key", probabilities, min(200_000, 100 * ranges))).first()[0] or [])) if probabilities else []
    edges = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def place(key):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, key.to_numpy(), side="left").astype(np.int32))

    placed = coded.withColumn("range", place("key"))
    sizes = dict(placed.groupBy("range").agg(F.sum("n")).collect())
    before, total = {}, 0
    for k in range(len(bounds) + 1):
        before[k] = total
        total += sizes.get(k, 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = None, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, k, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "range", "n", "ids")), strict=True):
                if k != current:
                    current, at = k, before[k]
                start = 0
                while start < n:
                    length = min(n - start, capacity - at % capacity)
                    piece = np.frombuffer(ids, dtype="<u2", count=length, offset=2 * start)
                    out.append((doc, start, length, piece.tobytes(), zlib.crc32(piece.astype("<u4").tobytes()), n, at // capacity, at % capacity))
                    start += length
                    at += length
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    tasks = max(1, min(len(bounds) + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = placed.repartition(tasks, "range").sortWithinPartitions("range", "key", "doc_id", "n")
    return dealt.mapInArrow(cut, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_pack_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, documents(spark, sf_dir)).drop("ids")
