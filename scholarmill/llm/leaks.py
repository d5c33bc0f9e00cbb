"""Evaluation passages that occur, wholly or partly, in a corpus.

Each shard of the corpus gets one FM-index over its words, in which all passages are searched, a block at a time. Their
four-word phrases are searched backward and located; where enough phrases of one passage lie near one diagonal of a
document, the two are aligned by their longest common blocks, and runs of at least 20 passage words with up to one word
in eight changed, dropped or added are leaks. Spans of a document are merged.
"""

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.llm.fmindex import FMIndex
from scholarmill.llm.words import words

RUN, EDITS = 20, 8  #: words of a run; one edit in so many words
PHRASE, HITS = 4, 5  #: a run of 20 words with 3 edits keeps at least 5 of its 17 phrases of four words, longer ones with one edit in eight more
BAND = 8
#: A phrase of SHARED_WORDS words in at least SHARED passages is an instruction line.
SHARED_WORDS, SHARED = 10, 8
SHARD_WORDS = 600_000
BLOCK = 2000  #: passages that are searched at a time


class Passages:
    """The passages to search: distinct word sequences without instruction lines, and their phrases."""

    def __init__(self, items: list[tuple[int, str | None]], shared_lines: set[tuple[str, ...]]):
        """``shared_lines``: the phrases of instruction lines."""
        seqs: dict[tuple[str, ...], list[int]] = {}
        for item, text in items:
            seqs.setdefault(tuple(words(text)), []).append(item)
        parts: dict[tuple[str, ...], set[int]] = {}
        for s, ids in seqs.items():
            shared = np.zeros(len(s) + 1, bool)
            shared[-1] = True
            for i in range(len(s) - SHARED_WORDS + 1):
                if s[i : i + SHARED_WORDS] in shared_lines:
                    shared[i : i + SHARED_WORDS] = True
            start = 0
            for end in np.flatnonzero(shared):
                if end - start >= RUN - RUN // EDITS:
                    parts.setdefault(s[start:end], set()).update(ids)
                start = end + 1
        self.seqs = list(parts)
        self.ids = [sorted(parts[s]) for s in self.seqs]
        self.vocabulary = sorted({w for s in self.seqs for w in s})
        number = {w: k for k, w in enumerate(self.vocabulary)}
        grams: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, s in enumerate(self.seqs):
            coded = [number[w] for w in s]
            for i in range(len(s) - PHRASE + 1):
                grams.setdefault(tuple(coded[i : i + PHRASE]), []).append((k, i))
        self.phrases = np.array(list(grams), np.int32).reshape(-1, PHRASE)
        at = [p for ps in grams.values() for p in ps]
        self.of = np.array([p[0] for p in at], np.int32)
        self.pos = np.array([p[1] for p in at], np.int32)
        self.ends = np.concatenate([[0], np.cumsum([len(v) for v in grams.values()])]).astype(np.int64)


class Shard:
    """Documents with an FM-index over all their words; 1 stands for a document's end."""

    def __init__(self, docs: list[list[str]]):
        self.docs = docs
        self.symbol: dict[str, int] = {}
        size = np.array([len(d) + 1 for d in docs])
        self.start = np.concatenate([[0], np.cumsum(size)])
        seq = np.ones(int(self.start[-1]), np.int32)
        for k, d in enumerate(docs):
            seq[self.start[k] : self.start[k] + len(d)] = [self.symbol.setdefault(w, len(self.symbol) + 2) for w in d]
        self.index = FMIndex(seq, len(self.symbol) + 1)


def runs(passage: list[str], doc: list[str]) -> list[tuple[int, int, int, int]]:
    """(passage from, to, document from, to) of the longest runs in the two word lists that are leaks, not overlapping."""
    blocks = [b for b in SequenceMatcher(None, passage, doc, False).get_matching_blocks() if b.size]
    found = []
    for i, a in enumerate(blocks):
        edits = 0
        for j in range(i, len(blocks)):
            if j > i:
                p, b = blocks[j - 1], blocks[j]
                edits += max(b.a - p.a - p.size, b.b - p.b - p.size)
            b = blocks[j]
            span = b.a + b.size - a.a
            if span >= RUN and EDITS * edits <= span + EDITS // 2:
                found.append((a.a, b.a + b.size, a.b, b.b + b.size))
    found.sort(key=lambda r: r[0] - r[1])
    out: list[tuple[int, int, int, int]] = []
    for r in found:
        if all(r[1] <= o[0] or r[0] >= o[1] for o in out):
            out.append(r)
    return out


def search_shard(shard: Shard, passages: Passages) -> list[tuple[int, int, int, int]]:
    """(document number, passage number, first word, end word in the document) of the leaks in a shard."""
    number = np.array([shard.symbol.get(w, 0) for w in passages.vocabulary], np.int64)
    coded = number[passages.phrases]
    known = np.flatnonzero((coded > 0).all(axis=1))
    if not len(known):
        return []
    docs, start, index = shard.docs, shard.start, shard.index
    low, high = index.search(coded[known])
    n = high - low
    hit = np.flatnonzero(n)
    if not len(hit):
        return []
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(n[hit])[:-1]]), n[hit]) + np.arange(int(n[hit].sum()))
    where, phrase = index.locate(rows), known[np.repeat(hit, n[hit])]
    times = passages.ends[phrase + 1] - passages.ends[phrase]
    out: list[tuple[int, int, int, int]] = []
    order = np.argsort(where)
    where, phrase, times = where[order], phrase[order], times[order]
    # in parts of a few million pairs of an occurrence and a passage position, cut between documents
    doc = np.searchsorted(start, where, "right") - 1
    total = np.cumsum(times)
    cuts = [0]
    while cuts[-1] < len(doc):
        c = int(np.searchsorted(total, (total[cuts[-1] - 1] if cuts[-1] else 0) + 4_000_000, "right"))
        c = len(doc) if c >= len(doc) else int(np.searchsorted(doc, doc[max(c, cuts[-1])], "left"))
        if c <= cuts[-1]:
            c = int(np.searchsorted(doc, doc[cuts[-1]], "right"))
        cuts.append(c)
    for a, b in zip(cuts, cuts[1:]):
        out += _aligned(docs, passages, start, doc[a:b], where[a:b], phrase[a:b], times[a:b])
    return out


def _aligned(docs, passages, start, doc, where, phrase, times) -> list[tuple[int, int, int, int]]:
    count = len(passages.seqs)
    at = np.repeat(passages.ends[phrase] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(int(times.sum()))
    item, pos = passages.of[at].astype(np.int64), passages.pos[at].astype(np.int64)
    doc, where = np.repeat(doc, times), np.repeat(where, times)
    base = doc[0]
    pair = (doc - base) * count + item
    _, group, times = np.unique(pair, return_inverse=True, return_counts=True)
    keep = times[group] >= HITS  # else too few phrases in the whole document
    pair, item, pos, doc, where = pair[keep], item[keep], pos[keep], doc[keep], where[keep]
    if not len(pair):
        return []
    word = where - start[doc]
    diagonal = word - pos + (1 << 20)
    chosen: dict[int, list[tuple[int, int, int]]] = {}
    for shift in (0, BAND // 2):  # edits move a run by a few diagonals: one of two overlapping bands holds it
        band = (diagonal + shift) // BAND
        order = np.lexsort((word, band, pair))
        p, d, w = pair[order], band[order], word[order]
        k = HITS - 1
        if len(p) <= k:
            continue
        near = (p[k:] == p[:-k]) & (d[k:] == d[:-k]) & (w[k:] - w[:-k] <= RUN + EDITS)
        for i in np.flatnonzero(near):
            j = order[i]
            chosen.setdefault(int(p[i]), []).append((int(word[j]), int(pos[j]), int(d[i])))
    out = []
    for p, seeds in chosen.items():
        k, q = base + p // count, p % count
        seq, text = passages.seqs[q], docs[k]
        seen: list[tuple[int, int]] = []
        for w, x, _ in sorted(seeds):
            if any(a <= w < b for a, b in seen):
                continue
            a, b = max(0, w - x - EDITS), min(len(text), w - x + len(seq) + len(seq) // EDITS + EDITS)
            for r in runs(list(seq), text[a:b]):
                out.append((int(k), int(q), a + r[2], a + r[3]))
            seen.append((a, b))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def shared_phrases(items: DataFrame, text: str) -> set[tuple[str, ...]]:
    """Phrases of SHARED_WORDS words in at least SHARED distinct passages, counted over all items."""

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(words(t)) for t in batch.column(0).to_pylist()], pa.string())], names=["s"])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = (t.split(" ") for t in batch.column(0).to_pylist())
            found = [g for w in cut for g in {" ".join(w[i : i + SHARED_WORDS]) for i in range(len(w) - SHARED_WORDS + 1)}]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["g"])

    each = items.select(text).filter(F.length(text) > 0).mapInArrow(sequences, "s string").distinct().mapInArrow(phrases, "g string")
    return {tuple(r[0].split(" ")) for r in each.groupBy("g").count().filter(F.col("count") >= SHARED).select("g").collect()}


def leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item_ids, spans): the documents that hold passages of ``items``, which passages, and where.

    spans are (first word, end word) in the document's words, merged. Null, empty and short texts leak nothing; items of
    the same passage leak together. The passages are a stated query set, taken in order in blocks of BLOCK that are sent
    to all tasks; each shard is indexed once and searched for one block after the other. Which phrases are shared is
    counted over all items before.
    """
    kind = dict(documents.dtypes)[key]
    lines = shared_phrases(items, item_text)
    sent, block = [], []
    for r in items.select(item_key, item_text).orderBy(item_key).toLocalIterator():
        block.append(tuple(r))
        if len(block) == BLOCK:
            sent.append(documents.sparkSession.sparkContext.broadcast(Passages(block, lines)))
            block = []
    if block or not sent:
        sent.append(documents.sparkSession.sparkContext.broadcast(Passages(block, lines)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _shards(batches):
            shard = Shard(docs)
            by: dict[int, tuple[set[int], list[tuple[int, int]]]] = {}
            for one in sent:
                passages = one.value
                for d, q, a, b in search_shard(shard, passages):
                    of, spans = by.setdefault(d, (set(), []))
                    of.update(passages.ids[q])
                    spans.append((a, b))
                if len(sent) > 1:
                    vars(one).pop("_value", None)  # one block in memory at a time
            if by:
                ds = sorted(by)
                spans = [[{"first": a, "end": b} for a, b in merged(by[d][1])] for d in ds]
                span = pa.struct([("first", pa.int32()), ("end", pa.int32())])
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in ds], ids_type(kind)), pa.array([sorted(by[d][0]) for d in ds], pa.list_(pa.int64())), pa.array(spans, pa.list_(span))], names=[key, "item_ids", "spans"])

    return documents.select(key, text).filter(F.length(text) > 0).mapInArrow(run, f"`{key}` {kind}, item_ids array<bigint>, spans array<struct<first:int,end:int>>")


def ids_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str]]]]:
    """Documents of about SHARD_WORDS words at a time."""
    ids, docs, n = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = words(t)
            if len(w) < RUN - RUN // EDITS:
                continue
            ids.append(i)
            docs.append(w)
            n += len(w)
            if n >= SHARD_WORDS:
                yield ids, docs
                ids, docs, n = [], [], 0
    if docs:
        yield ids, docs
