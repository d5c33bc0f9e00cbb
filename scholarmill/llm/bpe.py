"""Byte-pair encoding of a text column with a public vocabulary, in numpy.

Texts are cut by the vocabulary's pattern; each distinct piece is encoded once. Pieces lie in padded matrices, one for
each bucket of lengths; in every round each row merges its leftmost pair of the lowest rank, found in a hashed pair
table, and is then closed up; rows without a pair leave the matrix.
"""

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NONE = np.int32(2**31 - 1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the public vocabulary ``name`` lies; another place can be given to every function here."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def pattern() -> str:
    """The pattern by which the vocabulary's texts are cut, as published with it."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Open-addressing table from a pair of ids to the id of its merge, which is its rank too."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 2.5))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            free = self.keys[slot[todo]] < 0
            _, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            taken = self.keys[slot[todo]] >= 0
            slot[todo[taken]] = (slot[todo[taken]] + 1) & ((1 << self.bits) - 1)
        self.bytes = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the merges of ``a`` with ``b``, NONE where there is none (padding is negative)."""
        key = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero(((a >= 0) & (b >= 0)).ravel())
        flat, res = key.ravel(), out.ravel()
        slot = self._slot(flat[todo])
        while len(todo):
            at = self.keys[slot]
            hit = at == flat[todo]
            res[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (at >= 0)
            todo, slot = todo[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return res.reshape(key.shape)


def merge_matrix(ids: np.ndarray, table: PairTable) -> list[np.ndarray]:
    """The tokens of each row of ``ids``, whose padding is -1."""
    out: list[np.ndarray | None] = [None] * len(ids)
    row = np.arange(len(ids))
    rank = table.find(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.full((len(ids), 1), NONE)
    while len(row):
        at = rank.argmin(axis=1)  # the first of equal ranks, the leftmost pair
        low = rank[np.arange(len(row)), at]
        done = low == NONE
        if done.any():
            for k in np.flatnonzero(done):
                out[row[k]] = ids[k][ids[k] >= 0]
            keep = ~done
            row, ids, rank, at, low = row[keep], ids[keep], rank[keep], at[keep], low[keep]
            if not len(row):
                break
        width = int((ids >= 0).sum(axis=1).max())
        ids = ids[:, :width]
        col, n = np.arange(width - 1), np.arange(len(row))
        ids[n, at] = low
        ids = np.concatenate([np.where(col[None, :] > at[:, None], ids[:, 1:], ids[:, :-1]), np.full((len(row), 1), -1, np.int32)], axis=1)
        rank = rank[:, : width - 1]
        rank = np.concatenate([np.where(col[None, :-1] > at[:, None], rank[:, 1:], rank[:, :-1]), np.full((len(row), 1), NONE, np.int32)], axis=1)
        right = np.minimum(at + 1, width - 1)
        rank[n, np.minimum(at, width - 2)] = table.find(ids[n, at], np.where(at + 1 < width, ids[n, right], -1))
        left = at > 0
        rank[n[left], at[left] - 1] = table.find(ids[n[left], at[left] - 1], ids[n[left], at[left]])
    return out  # type: ignore[return-value]


def merge_long(ids: np.ndarray, table: PairTable) -> np.ndarray:
    """The tokens of one very long piece, by a heap over a linked list: the same order of merges in n log n."""
    n = len(ids)
    tok, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    rank = table.find(ids[:-1], ids[1:])
    heap = [(int(rank[i]), i, tok[i], tok[i + 1]) for i in np.flatnonzero(rank != NONE)]
    heapq.heapify(heap)

    def push(i: int, j: int) -> None:
        if i >= 0 and j < n:
            r = int(table.find(np.array([tok[i]]), np.array([tok[j]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, tok[i], tok[j]))

    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if tok[i] != a or j >= n or tok[j] != b:
            continue
        tok[i], tok[j], after[i] = r, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        push(before[i], i)
        push(i, after[i])
    return np.array([t for t in tok if t >= 0], np.int32)


class Encoder:
    """Encodes texts; made once on the driver and sent to the executors (a few MB, fixed by the vocabulary)."""

    LONG = 256  #: bytes above which a piece goes through the heap
    KEPT = 400_000  #: pieces remembered in a worker

    def __init__(self, ranks: dict[bytes, int], pat: str):
        self.table, self.pat = PairTable(ranks), pat

    @classmethod
    def load(cls, path: str | None = None, pat: str | None = None) -> "Encoder":
        with open(path or vocabulary_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return cls(ranks, pat or pattern())

    def __getstate__(self) -> dict:
        return {"table": self.table, "pat": self.pat}

    def pieces(self, words: list[str]) -> list[list[int]]:
        """Token ids of each of ``words``."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[list[int]] = [[] for _ in raw]
        low = 0
        for high in (1, 2, 4, 6, 8, 12, 16, 24, 32, 64, 128, self.LONG):
            which = np.flatnonzero((size > low) & (size <= high))
            low = high
            for part in np.array_split(which, max(1, len(which) * high // 2_000_000)):
                if not len(part):
                    continue
                flat = self.table.bytes[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                ids = np.full((len(part), high), -1, np.int32)
                ids[np.arange(high)[None, :] < size[part][:, None]] = flat
                for i, x in zip(part, merge_matrix(ids, self.table)):
                    out[i] = x.tolist()
        for i in np.flatnonzero(size > self.LONG):
            out[i] = merge_long(self.table.bytes[np.frombuffer(raw[i], np.uint8)], self.table).tolist()
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Token ids of each text; of null and empty ones none."""
        import regex

        if not hasattr(self, "known"):
            self.known: dict[str, list[int]] = {}
            self.find = regex.compile(self.pat).findall
        cut = [self.find(t) if t else [] for t in texts]
        if len(self.known) > self.KEPT:
            self.known = {}
        new = list({w for ws in cut for w in ws} - self.known.keys())
        self.known.update(zip(new, self.pieces(new)))
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in cut]


def encode_column(df: DataFrame, key: str, text: str, encoder: Encoder, ids: str = "ids") -> DataFrame:
    """(key, ids) of each row of ``df``: ids are the tokens of ``text``, an empty list for a null or empty text.

    Other columns are left out, so none can clash. Rows repeat as in ``df``.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(encoder)
    shape = df.select(F.col(key)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = sent.value
        for batch in batches:
            lists = enc.encode(batch.column(1).to_pylist())
            ends = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            values = pa.array(np.fromiter((i for x in lists for i in x), np.int32, int(ends[-1])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], names=[key, ids])

    return df.select(key, text).mapInArrow(run, T.StructType([*shape.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))
