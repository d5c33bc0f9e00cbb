"""Same or near-same records across splits: an exact prefix-filter join on rare word shingles.

Two papers overlap when at least SHARE of the words of the longer one stand in the other in the same order. A word of
one paper without a partner breaks at most SHINGLE of its shingles, one of the other that is added at another place at
most SHINGLE - 1; so however the shingles are ordered, the first ones of either paper, one more than can be broken, have
one in common. The order is from rare to frequent. Copies are one class each, joined once.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.llm.words import word_hash
from scholarmill.plans.stage import stage

SHARE = 0.9
SHINGLE = 3  #: five words would put nine tenths of all shingles into the prefix at one edit in ten words; three put half
FREQUENT = 65_536  #: words that make up at least 1 / FREQUENT of all text, so never more than FREQUENT
OFTEN = 1000  #: a shingle is frequent from one text in so many on
BUCKETS = 128  #: of a sketch
BROADCAST_IDS = 1_000_000  #: up to so many ids (8 MB) a list of ids is broadcast, beyond it is shuffled
WORD = re.compile(r"[^\W_]+")
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def edits(n: int) -> int:
    """How many words of a text of ``n`` words can be without a partner in an overlapping one."""
    return n - int(np.ceil(SHARE * n - 1e-9))


def broken(n: int) -> int:
    """How many shingles of a text of ``n`` words an overlapping one can lack, be it as long, longer or shorter.

    Of a partner of ``k`` words, not less than n, at least k - edits(k) are common: edits(k) - (k - n) words of this text
    have no partner and edits(k) of the other. A shorter partner lacks no more than one of n words.
    """
    return max(max(0, SHINGLE * (edits(k) - (k - n))) + (SHINGLE - 1) * edits(k) for k in range(n, int(n / SHARE + 1e-9) + 1))


def texts(df: DataFrame, key: str, text: str, is_eval: str) -> DataFrame:
    """(id, is_eval, n, fp1, fp2, words): hashed words of each text with a word, and a 128-bit fingerprint of them.

    Null, empty and wordless texts have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [WORD.findall(t.lower()) for t in batch.column(2).to_pylist()]
            keep = [k for k, w in enumerate(cut) if w]
            flat = np.fromiter((word_hash(w) for k in keep for w in cut[k]), np.int32)
            ends = np.concatenate([[0], np.cumsum([len(cut[k]) for k in keep])]).astype(np.int32)
            prints = np.frombuffer(b"".join(hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])), np.int64).reshape(-1, 2)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(np.diff(ends)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["id", "is_eval", "n", "fp1", "fp2", "words"],
            )

    rows = df.select(F.col(key).cast("long"), F.col(is_eval), F.col(text)).filter(F.length(text) > 0)
    return rows.mapInArrow(run, "id long, is_eval boolean, n int, fp1 long, fp2 long, words array<int>")


def word_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent words of all texts with their weights, sorted by word; the others have the least weight, 0."""
    total = rows.agg(F.sum("n")).first()[0] or 0
    least = max(2, total // FREQUENT + 1)
    counts = rows.select(F.explode("words").alias("w")).groupBy("w").count().filter(F.col("count") >= least).collect()
    word = np.array([r[0] for r in counts], np.int32)
    weight = np.round(16 * np.log2(np.array([r[1] for r in counts], np.float64) / least + 1)).astype(np.int32)
    order = np.argsort(word)
    return word[order], weight[order]


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles of a text, in order; a text shorter than a shingle is one."""
    q = min(SHINGLE, len(words))
    w = words.astype(np.uint64)
    m = len(words) - q + 1
    h = np.full(m, q, np.uint64)
    for k in range(q):
        h = (h ^ (w[k : k + m] * _MUL[k])) * _MUL[0]
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    column = batch.column(name)
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return (flat[a:b] for a, b in zip(ends, ends[1:]))


def frequent_shingles(rows: DataFrame, one_in: int = OFTEN) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least one text of ``one_in``, with weights, sorted; found over all texts.

    A shingle that is so frequent over all is as frequent in some run of texts; each run names only those, at most
    ``one_in`` for each shingle of a text, and the counts are added. They order shingles and decide nothing else.
    """
    texts_n = rows.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def count() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= max(2, len(held) // one_in)
            return pa.RecordBatch.from_arrays([pa.array(h[often]), pa.array(n[often].astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for words in _lists(batch, "words"):
                held.append(shingles(words))
                size += len(words)
                if size > 1_000_000:
                    yield count()
                    held, size = [], 0
        if held:
            yield count()

    counts = rows.select("words").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    kept = counts.filter(F.col("c") >= max(3, texts_n // one_in)).orderBy(F.desc("c"), "h").limit(FREQUENT).collect()
    h, c = np.array([r[0] for r in kept], np.int64), np.array([r[1] for r in kept], np.float64)
    order = np.argsort(h)
    return h[order], (10_000 + np.round(16 * np.log2(c[order] + 1))).astype(np.int32)


def prefix(words: np.ndarray, common: tuple[np.ndarray, np.ndarray], often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the rarest shingles of a text: one more than its edits can break, all of a short text.

    Shingles are as rare as their words, unless they are known to be frequent.
    """
    n = len(words)
    code = shingles(words)
    m = len(code)
    take = m if n < 2 * SHINGLE else min(m, broken(n) + 1)
    of = _weights(words, *common)
    score = sum(of[k : k + m] for k in range(min(SHINGLE, n)))
    score = np.maximum(score, _weights(code, *often))
    order = np.lexsort((np.arange(m), code, score))[:take]
    return code[order], order.astype(np.int32)


def _weights(x: np.ndarray, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), np.int32)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, weight[at], 0)


def prefixes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], often: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(id, is_eval, n, h, pos): a row for each prefix shingle of each text."""
    sent = rows.sparkSession.sparkContext.broadcast((common, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(w, *sent.value) for w in _lists(batch, "words")]
            if not found:
                continue
            size = np.array([len(h) for h, _ in found])
            rep = pa.array(np.repeat(np.arange(len(found)), size))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rep) for k in range(3)), pa.array(np.concatenate([h for h, _ in found])), pa.array(np.concatenate([p for _, p in found]))], names=["id", "is_eval", "n", "h", "pos"])

    return rows.select("id", "is_eval", "n", "words").mapInArrow(run, "id long, is_eval boolean, n int, h long, pos int")


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel: one step of long integers for each word of ``b``."""
    if len(a) > len(b):
        a, b = b, a
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def bag(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two texts have in common in any order, or more: no common subsequence is longer."""
    x, y = (np.bincount(w & 4095, minlength=4096) for w in (a, b))
    return int(np.minimum(x, y).sum())


def sketches(rows: DataFrame) -> DataFrame:
    """(id, sketch): how many words of each text fall into each of BUCKETS; null if a count is out of range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [np.bincount(w % BUCKETS, minlength=BUCKETS) for w in _lists(batch, "words")]
            found = [c.astype("<u2").tobytes() if c.max() < 65_536 else None for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "sketch"])

    return rows.select("id", "words").mapInArrow(run, "id long, sketch binary")


def possible(pairs: DataFrame) -> DataFrame:
    """Of (ea, tb, sketch, sketch2) the pairs (ea, tb) whose sketches allow enough common words; it loses no overlap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if x is None or y is None:
                    keep.append(True)
                    continue
                a, b = (np.frombuffer(s, "<u2").astype(np.int64) for s in (x, y))
                n = int(max(a.sum(), b.sum()))
                keep.append(int(np.minimum(a, b).sum()) >= n - edits(n))
            yield batch.select(["ea", "tb"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("ea", "tb", "sketch", "sketch2").mapInArrow(run, "ea long, tb long")


def verified(pairs: DataFrame) -> DataFrame:
    """Of (…, words, words2) the pairs that overlap, without the words."""
    names = [c for c in pairs.columns if c not in ("words", "words2")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(_lists(batch, "words"), _lists(batch, "words2")):
                n = max(len(a), len(b))
                least = n - edits(n)
                keep.append(bag(a, b) >= least and common_words(a, b) >= least)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, pairs.select(names).schema)


def _only(rows: DataFrame, ids: DataFrame, how: str, n: int) -> DataFrame:
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "id", how)


def overlaps(df: DataFrame, key: str, text: str, is_eval: str) -> DataFrame:
    """(id_a, id_b), the smaller first: one row in training and one in evaluation whose texts overlap; each pair once.

    ``is_eval`` is a boolean column; rows where it is null are in no split and left out.
    """
    rows = stage(texts(df.filter(F.col(is_eval).isNotNull()), key, text, is_eval))
    member = rows.select("id", "is_eval", "fp1", "fp2").distinct()
    classes = rows.groupBy("fp1", "fp2").agg(F.min("id").alias("id"), F.bool_or("is_eval").alias("has_eval"), F.bool_or(~F.col("is_eval")).alias("has_train"))
    classes = stage(classes)
    # one row of each class stands for it; the list of the others is broadcast only where it is short
    others = member.select("id", "fp1", "fp2").join(classes.select("fp1", "fp2", F.col("id").alias("first")), ["fp1", "fp2"]).filter("id <> first").select("id").distinct()
    n_classes, n_ids = classes.count(), member.select("id").distinct().count()
    alone = _only(rows, others, "left_anti", n_ids - n_classes)
    common, often = word_counts(rows), frequent_shingles(rows)
    roles = classes.filter("has_eval and has_train").select("id")
    # texts that are in one split only keep their role; copies across splits play both
    ea, tb = alone.filter("is_eval"), alone.filter("not is_eval")
    if n_both := roles.count():
        both = _only(alone, roles, "left_semi", n_both)
        ea, tb = ea.unionByName(both.filter("not is_eval")), tb.unionByName(both.filter("is_eval"))
    e = prefixes(ea, common, often).select("h", F.col("id").alias("ea"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    t = prefixes(tb, common, often).select("h", F.col("id").alias("tb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    longest = F.greatest("na", "nb")
    free = longest - F.ceil(longest * SHARE - 1e-9)
    near = e.join(t, "h").filter((F.col("ea") != F.col("tb")) & (F.abs(F.col("na") - F.col("nb")) <= free) & (F.abs(F.col("pa") - F.col("pb")) <= free))
    candidates = stage(near.select("ea", "tb").distinct())
    n = candidates.count()
    ids = lambda df: df.select(F.col("ea").alias("id")).union(df.select(F.col("tb").alias("id"))).distinct()
    sketch = sketches(_only(alone.select("id", "words"), ids(candidates), "left_semi", 2 * n).dropDuplicates(["id"]))
    pair = candidates.join(sketch.withColumnsRenamed({"id": "ea"}), "ea").join(sketch.withColumnsRenamed({"id": "tb", "sketch": "sketch2"}), "tb")
    candidates = stage(possible(pair))
    n = candidates.count()
    words = _only(alone.select("id", "fp1", "fp2", "words"), ids(candidates), "left_semi", 2 * n).dropDuplicates(["id"])
    pair = candidates.join(words.withColumnsRenamed({"id": "ea"}), "ea")
    pair = pair.join(words.withColumnsRenamed({"id": "tb", "fp1": "gp1", "fp2": "gp2", "words": "words2"}), "tb")
    close = verified(pair.select("fp1", "fp2", "gp1", "gp2", "words", "words2"))
    same = classes.filter("has_eval and has_train").select("fp1", "fp2", F.col("fp1").alias("gp1"), F.col("fp2").alias("gp2"))
    pairs = close.unionByName(same).distinct()
    out = pairs.join(member.filter("is_eval").select("fp1", "fp2", F.col("id").alias("a")), ["fp1", "fp2"])
    out = out.join(member.filter("not is_eval").select(F.col("fp1").alias("gp1"), F.col("fp2").alias("gp2"), F.col("id").alias("b")), ["gp1", "gp2"])
    return out.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).filter("id_a <> id_b").distinct()
