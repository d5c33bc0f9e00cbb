"""Matching records of several sources that share no key.

Candidates are blocked by MinHash across attributes: bands of minima of an abstract's rare shingles; three of a title's
words, as letter sets so that swapped and doubled letters agree, and three of their first letters, by MinHash over the
sets of three; minima of words with minima of names. Each candidate pair gets similarity features; a logistic classifier is trained on weak labels, pairs seen without
their abstracts labelled by whether these agree, and calibrated on held-out ones. Words that tell papers of a like title
apart (sequels, replies, surveys) are learned from the same pairs. A record matches its most probable paper.
"""

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.llm.lookalike import consistent
from scholarmill.llm.overlap import SHINGLE, _weights, frequent_shingles, shingles
from scholarmill.llm.words import word_hash
from scholarmill.plans.stage import drop, stage

BANDS, ROWS = 24, 2  #: of abstracts; a sketch has bits of all 48 minima
TITLE_ORDERS, HEAD_ORDERS, SHORT_ORDERS = 60, 40, 24  #: random orders of words, of first letters and of the words of short titles
NAME_BANDS = 20  #: of a word and a name each
OFTEN = 100  #: a shingle in one abstract of so many is frequent
SAMPLE = 20_000  #: at most so many candidate pairs train the classifier
KEY_BYTES = 80  #: of a key with its sketch, shuffled
RECORD_BYTES, SLICE_BYTES = 200, 1 << 27  #: a slice of the keys has at most so many bytes a record, or so many in all if these are more
PARTS = 256  #: of the records by number
PAIRS = 3  #: at most so many pairs a record are on disk, if one part has no more
PASS = 250_000  #: pairs that meet their attributes in one pass, or one for every four records if these are more
TITLE_STOP = 0.06  #: a title word in so large a share of titles says nothing; with n words a title there are at most n / TITLE_STOP
THRESHOLD = 0.5
WORD = re.compile(r"[^\W_]+")
_SEEDS = np.random.default_rng(7).integers(1, 2**63 - 1, 512, dtype=np.int64).astype(np.uint64) | np.uint64(1)


def title_words(title: str | None) -> list[str]:
    """The words of a title in lower case."""
    return WORD.findall(consistent(title).lower()) if title else []


@lru_cache(maxsize=200_000)
def letters(word: str) -> int:
    """A hash of the set of a word's letters: the same for swapped and doubled letters."""
    return zlib.crc32("".join(sorted(set(word))).encode()) & 0x7FFFFFFF


def names(authors: str | None) -> set[str]:
    """Name parts of at least three letters."""
    return {w for w in WORD.findall(consistent(authors).lower()) if len(w) > 2 and w != "and"} if authors else set()


RECORD = "rid long, source_name string, has_abstract boolean, title array<int>, heads array<int>, chars array<int>, tokens array<int>, words array<int>, people array<int>, year int"


def records(df: DataFrame) -> DataFrame:
    """Hashed attributes of (source_name, rid, title, abstract, authors, year)."""
    names_of = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in names_of}
            for source, rid, title, abstract, authors, year in zip(*(c.to_pylist() for c in batch.columns)):
                tw = title_words(title)
                words = [word_hash(w) for w in WORD.findall(consistent(abstract).lower())] if abstract else []
                joined = f" {' '.join(tw)} "
                rows["rid"].append(rid)
                rows["source_name"].append(source)
                rows["has_abstract"].append(len(words) >= 10)
                rows["title"].append(list(dict.fromkeys(map(letters, tw))))
                rows["heads"].append(list(dict.fromkeys(zlib.crc32(w[:3].encode()) & 0x7FFFFFFF for w in tw if len(w) > 3)))
                rows["chars"].append(sorted({zlib.crc32(joined[i : i + 3].encode()) & 0x7FFFFFFF for i in range(len(joined) - 2)}) if tw else [])
                rows["tokens"].append(sorted({word_hash(w) for w in tw}))
                rows["words"].append(words)
                rows["people"].append(sorted(map(word_hash, names(authors))))
                rows["year"].append(year)
            kinds = {"rid": pa.int64(), "source_name": pa.string(), "has_abstract": pa.bool_(), "year": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(rows[n], kinds.get(n, pa.list_(pa.int32()))) for n in names_of], names=names_of)

    return df.select("source_name", "rid", "title", "abstract", "authors", "year").mapInArrow(run, RECORD)


Sets = tuple[np.ndarray, np.ndarray]  #: the numbers of the sets of a batch one after another, and how many each set has


def _of(sets: Sets) -> np.ndarray:
    """The set of each number."""
    return np.repeat(np.arange(len(sets[1])), sets[1])


def _where(sets: Sets, keep: np.ndarray) -> Sets:
    return sets[0][keep], np.bincount(_of(sets)[keep], minlength=len(sets[1]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    return x ^ (x >> np.uint64(31))


def hashed(x: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """``n`` hashes of each of an array's numbers, before its last axis, with the seeds from ``first`` on."""
    x = mixed(x)[..., None, :] * _SEEDS[first : first + n, None]
    return x ^ (x >> np.uint64(32))


def minima(sets: Sets, n: int, first: int = 0) -> np.ndarray:
    """The least of each of ``n`` hashes of each set; none may be empty."""
    starts = np.concatenate([[0], np.cumsum(sets[1])[:-1]])
    out = np.zeros((len(sets[1]), n), np.uint64)
    if len(out):
        x = mixed(sets[0])
        for k in range(n):
            h = x * _SEEDS[first + k]
            h ^= h >> np.uint64(32)
            out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _folded(columns: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    for column in columns:
        h = (h ^ column) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


Keys = list[tuple[np.ndarray, np.ndarray]]  #: (set, key)


def _distinct(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) without repeats of the rows of ``keys``, which are those of the sets ``at``."""
    keys = np.sort(keys, axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.repeat(at, new.sum(axis=1)), keys[new]


def lowest(sets: Sets, k: int, n: int, first: int, kind: int, most: int = 1 << 62) -> Keys:
    """MinHash over the subsets of ``k`` numbers of each set of up to ``most``: a key for the ``k`` that come first in each
    of ``n`` random orders.

    Sets of which c of u numbers are common have the same ones first with probability c (c-1) … / u (u-1) …; the same ones
    in two orders make one key.
    """
    out: Keys = []
    starts = np.cumsum(sets[1]) - sets[1]
    for size in np.unique(sets[1][(sets[1] > 0) & (sets[1] <= most)]).tolist():
        which = np.flatnonzero(sets[1] == size)
        orders = n if size > k else 1  # a set of up to k numbers is the same in any order
        step = max(1, 2_000_000 // (orders * size))
        for at in (which[i : i + step] for i in range(0, len(which), step)):
            x = sets[0][starts[at][:, None] + np.arange(size)].astype(np.int64)
            if orders > 1:
                some = np.argpartition(hashed(x, n, first), k - 1, axis=2)[:, :, :k]
                x = np.take_along_axis(x[:, None, :], some, axis=2)
            else:
                x = x[:, None, :]
            x = np.sort(x, axis=2).astype(np.uint64)
            out.append(_distinct(at, _folded([x[:, :, i] for i in range(x.shape[2])], np.full(x.shape[:2], kind, np.uint64))))
    return out


def bands(at: np.ndarray, m: np.ndarray, rows: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, key): a key for each ``rows`` minima of the sets ``at``; keys of different bands and kinds differ."""
    m = m.reshape(len(m), -1, rows)
    h = np.tile(np.arange(m.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind), (len(m), 1))
    return _distinct(at, _folded([m[:, :, k] for k in range(rows)], h))


class Frequent:
    """What says little: frequent shingles, and title words in so large a share of records."""

    def __init__(self, shingles_: tuple[np.ndarray, np.ndarray], stop: list[int]):
        self.shingles, self.stop = shingles_, np.array(sorted(stop), np.int64)
        self.often = np.unique(shingles_[0] & (1 << Keyed.BITS) - 1)

    def rare(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys of shingles are rare."""
        if not len(self.often):
            return np.ones(len(keys), bool)
        number = keys & (1 << Keyed.BITS) - 1
        return self.often[np.minimum(np.searchsorted(self.often, number), len(self.often) - 1)] != number

    def content(self, sets: Sets) -> Sets:
        """The words that aren't frequent; all of a title of little else than frequent words."""
        some = ~np.isin(sets[0], self.stop)
        return _where(sets, some | (_where(sets, some)[1] < 3)[_of(sets)])


def _filled(sets: Sets, which: np.ndarray | None = None) -> tuple[np.ndarray, Sets]:
    """The sets that have a number, and that ``which`` marks."""
    keep = sets[1] > 0 if which is None else which & (sets[1] > 0)
    return np.flatnonzero(keep), (sets[0][keep[_of(sets)]], sets[1][keep])


def abstract_sets(words: Sets, known: Frequent) -> tuple[Sets, Sets]:
    """The distinct shingles of abstracts, and those that aren't frequent; none of an abstract shorter than a shingle."""
    of, flat = _of(words), words[0]
    m = max(0, len(flat) - SHINGLE + 1)
    inside = of[:m] == of[len(of) - m :]  # not across the end of an abstract
    of, h = of[:m][inside], (shingles(flat) if m else flat[:0])[:m][inside]
    order = np.argsort(of << Keyed.BITS | h & (1 << Keyed.BITS) - 1)
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    every = h[new], np.bincount(of[new], minlength=len(words[1]))
    return every, _where(every, _weights(every[0], *known.shingles) == 0)


class Abstracts:
    """The abstracts of a batch: those with rare shingles and the minima of these, and those with few rare ones."""

    def __init__(self, words: Sets, known: Frequent):
        every, rare = abstract_sets(words, known)
        self.size, self.few = rare[1], 2 * rare[1] < every[1]
        self.at, part = _filled(rare)
        self.minima = minima(part, BANDS * ROWS)
        # where a group of near copies makes its own shingles frequent, all shingles block too
        self.few_at, part = _filled(every, self.few)
        self.few_minima = minima(part, BANDS * ROWS)


def abstract_keys(abstracts: Abstracts) -> Keys:
    """Bands of minima of the shingles of abstracts."""
    return [bands(at, m, ROWS, 0) for at, m in ((abstracts.at, abstracts.minima), (abstracts.few_at, abstracts.few_minima)) if len(at)]


def title_keys(title: Sets, known: Frequent) -> Keys:
    """Three of a title's words, of a title of up to three words two as well, and the whole title."""
    w = known.content(title)
    return lowest(w, 3, TITLE_ORDERS, 0, 1) + lowest(w, 2, SHORT_ORDERS, 200, 5, 3) + lowest(title, 1 << 40, 1, 0, 2) + lowest(w, 1 << 40, 1, 0, 2)


def head_keys(heads: Sets, known: Frequent) -> Keys:
    """Three of the first letters of a title's words."""
    return lowest(known.content(heads), 3, HEAD_ORDERS, 100, 4)


def name_keys(title: Sets, people: Sets, known: Frequent) -> Keys:
    """A word with a name each."""
    both = (title[1] > 0) & (people[1] > 0)
    at, w = _filled(known.content(title), both)
    m = np.stack([minima(w, NAME_BANDS, 300), minima(_filled(people, both)[1], NAME_BANDS, 330)], axis=2)
    return [bands(at, m.reshape(len(at), -1), 2, 3)] if len(at) else []


def all_keys(sets: dict[str, Sets], abstracts: Abstracts, known: Frequent) -> Keys:
    return abstract_keys(abstracts) + title_keys(sets["title"], known) + head_keys(sets["heads"], known) + name_keys(sets["title"], sets["people"], known)


def keys_of(title: list[int], heads: list[int], people: list[int], words: np.ndarray | None, known: Frequent) -> np.ndarray:
    """The blocking keys of a record: of its abstract, its title's words, their first letters, and words with names."""
    one = lambda x: (np.array(x, np.int64), np.array([len(x)]))
    sets = {"title": one(title), "heads": one(heads), "people": one(people)}
    out = [k for _, k in all_keys(sets, Abstracts(one([] if words is None else words), known), known)]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


WORDS_OF = {"abstract": BANDS * ROWS // 16, "chars": 4}  #: 64-bit words of a sketch
SKETCH = [f"chars{k}" for k in range(WORDS_OF["chars"])] + [f"abstract{k}" for k in range(WORDS_OF["abstract"])] + ["people", "n_chars", "n_abstract", "n_people"]
ANY = -1  #: n_abstract of a sketch that says nothing


def bitmaps(sets: Sets, n: int) -> np.ndarray:
    """A bit for each number of a set, in ``n`` 64-bit words for each set."""
    out, some = np.zeros((n, len(sets[1])), np.uint64), sets[1] > 0
    bit = hashed(sets[0], 1, 400)[0] >> np.uint64(8)
    slot, value = (bit >> np.uint64(6)) % np.uint64(n), np.uint64(1) << (bit & np.uint64(63))
    for k in range(n if some.any() else 0):
        out[k, some] = np.bitwise_or.reduceat(np.where(slot == k, value, np.uint64(0)), (np.cumsum(sets[1]) - sets[1])[some])
    return out


def sketches(chars: Sets, abstracts: Abstracts, people: Sets) -> list[np.ndarray]:
    """The columns SKETCH: a bit for each three letters of a title, four bits of each of an abstract's 48 minima, a bit for
    each name, and the sizes."""
    columns = [*bitmaps(chars, WORDS_OF["chars"]), *np.zeros((WORDS_OF["abstract"], len(chars[1])), np.uint64), bitmaps(people, 1)[0]]
    m = abstracts.minima >> np.uint64(20) & np.uint64(15)
    for k in range(WORDS_OF["abstract"]):
        columns[WORDS_OF["chars"] + k][abstracts.at] = np.bitwise_or.reduce(m[:, 16 * k : 16 * k + 16] << np.arange(0, 64, 4, dtype=np.uint64), axis=1)
    return [c.view(np.int64) for c in columns] + [chars[1], np.where(abstracts.few, ANY, abstracts.size), people[1]]


LIKE = 0.65  #: titles are alike when the shorter one has so large a share of its threes of letters in the other, names as well
WEAK, STRONG = 4, 8  #: abstracts without common shingles agree in 3 of the 48 minima's bits, those with a sixth in common in 10
SIZES = 2.5  #: from so many times the size on, a shortened abstract's minima say nothing


def _differ(k: int) -> str:
    x = f"(a_abstract{k} ^ b_abstract{k})"
    y = f"({x} | shiftrightunsigned({x}, 1))"
    return f"bit_count(({y} | shiftrightunsigned({y}, 2)) & {int('1' * 16, 16)}L)"


def _within(columns: list[str], size: str, share: float, least: int) -> str:
    """Whether ``share`` of the smaller set can be in the other: no more bits are missing there than numbers."""
    missing = [" + ".join(f"bit_count({p}_{c} & ~{q}_{c})" for c in columns) for p, q in ("ab", "ba")]
    return f"(least(a_{size}, b_{size}) >= {least} and if(a_{size} <= b_{size}, {missing[0]}, {missing[1]}) <= {1 - share:.2f}D * least(a_{size}, b_{size}))"


#: Whether a pair that shares a key is compared: abstracts are alike, or titles or names, unless both have abstracts of like
#: length that differ. Never false for like titles of which one lacks an abstract.
_EQUAL = f"({16 * WORDS_OF['abstract']} - {' - '.join(_differ(k) for k in range(WORDS_OF['abstract']))})"
_ALIKE = f"({_within([f'chars{k}' for k in range(WORDS_OF['chars'])], 'n_chars', LIKE, 1)} or {_within(['people'], 'n_people', LIKE, 2)})"
COMPARED = f"""a_n_abstract = {ANY} or b_n_abstract = {ANY} or (a_n_abstract > 0 and b_n_abstract > 0 and {_EQUAL} >= {STRONG}) or ({_ALIKE} and
    (a_n_abstract = 0 or b_n_abstract = 0 or {_EQUAL} >= {WEAK} or greatest(a_n_abstract, b_n_abstract) >= {SIZES}D * least(a_n_abstract, b_n_abstract)))"""


def _sets(batch: pa.RecordBatch, name: str) -> Sets:
    column = batch.column(name)
    ends = column.offsets.to_numpy()
    return column.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), np.diff(ends).astype(np.int64)


def blocks(rows: DataFrame, known: Frequent) -> DataFrame:
    """(rid, source_name, SKETCH…, keys): the sketch and the blocking keys of each record that has some."""
    sent = rows.sparkSession.sparkContext.broadcast(known)
    read = ["title", "heads", "people", "chars", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {c: _sets(batch, c) for c in read}
            sets["words"] = _where(sets["words"], np.array(batch.column("has_abstract").to_numpy(False), bool)[_of(sets["words"])])
            abstracts = Abstracts(sets["words"], sent.value)
            none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            at, keys = (np.concatenate(x) for x in zip(none, *all_keys(sets, abstracts, sent.value)))
            order = np.argsort(at, kind="stable")
            ends = np.searchsorted(at[order], np.arange(batch.num_rows + 1)).astype(np.int32)
            arrays = [batch.column("rid"), batch.column("source_name"), *map(pa.array, sketches(sets["chars"], abstracts, sets["people"]))]
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[order])))
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "source_name", *SKETCH, "keys"]).filter(pa.array(np.diff(ends) > 0))

    schema = "rid long, source_name string, " + ", ".join(f"{c} long" for c in SKETCH) + ", keys array<long>"
    return rows.select("rid", "source_name", "has_abstract", *read).mapInArrow(run, schema)


def _united(parts: list[DataFrame]) -> DataFrame:
    both = parts[0]
    for part in parts[1:]:
        both = both.union(part)
    return both


def candidates_of(keyed: DataFrame, first: int, last: int, slices: int) -> DataFrame:
    """(a_rid, b_rid): the distinct pairs that share a key and whose sketches agree, of any paper and the records of the
    ``first`` to before the ``last`` of PARTS parts.

    ``slices`` of the keys come one after another, so that only a share of them is on disk at a time. A pair is tested
    where it meets, before it is written anywhere.
    """
    part = F.pmod("rid", F.lit(PARTS))
    keyed = keyed.filter((F.col("source_name") == "a") | (part >= first) & (part < last))
    found = []
    for k in range(slices):
        mine = F.filter("keys", lambda h: F.pmod(h, F.lit(slices)) == k) if slices > 1 else F.col("keys")  # noqa: B023
        each = keyed.select("source_name", "rid", *SKETCH, F.explode(mine).alias("h"))
        ka, kb = (each.filter(F.col("source_name") == p).select("h", *[F.col(c).alias(f"{p}_{c}") for c in ("rid", *SKETCH)]) for p in "ab")
        found.append(stage(ka.join(kb, "h").filter(COMPARED).select("a_rid", "b_rid").distinct(), release=True))
    if slices == 1:
        return found[0]
    once = stage(_united(found).distinct(), release=True)
    for each in found:
        drop(each)
    return once


FEATURES = ("abstract", "no_abstract", "title_chars", "title_in", "title_words", "people", "no_people", "other_words", "year", "title_only", "title_in_only", "people_only", "other_words_only", "other_people_only", "bias")
OTHER, OTHER_ONLY, NO = FEATURES.index("other_words"), FEATURES.index("other_words_only"), FEATURES.index("no_abstract")
#: Where the weights of the classifier start; each labelled pair moves them, a table without labels keeps them.
START = np.array([9.0, 1.5, 1.5, 1.0, 1.5, 1.0, 0.5, -2.0, 0.7, 2.0, 1.0, 1.5, -2.0, -2.5, -5.5])


class Keyed:
    """Sets of numbers of the pairs of a batch, as one sorted array of (pair, number)."""

    BITS = 44

    def __init__(self, pair: np.ndarray, number: np.ndarray, n: int):
        keys = pair.astype(np.int64) << self.BITS | number.astype(np.int64) & (1 << self.BITS) - 1
        if not (keys[1:] > keys[:-1]).all():
            keys.sort()  # np.unique hashes whole numbers, which takes several times as long
            keys = keys[np.append(True, keys[1:] != keys[:-1])]
        self.keys = keys
        self.n = n
        self.size = self.count(self.keys)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return np.bincount(keys >> self.BITS, minlength=self.n)

    def common(self, other: "Keyed") -> np.ndarray:
        """How many numbers each pair's sets have in common."""
        return self.count(np.intersect1d(self.keys, other.keys, assume_unique=True))

    def share(self, other: "Keyed") -> np.ndarray:
        """The common numbers by those of the smaller set; 0 where one is empty."""
        return self.common(other) / np.maximum(1, np.minimum(self.size, other.size))

    def apart(self, other: "Keyed") -> tuple[np.ndarray, np.ndarray]:
        """(pair, number) of what only one of the two has."""
        keys = np.setxor1d(self.keys, other.keys, assume_unique=True)
        return keys >> self.BITS, keys & (1 << self.BITS) - 1


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    ends = column.offsets.to_numpy()
    return np.repeat(np.arange(batch.num_rows), np.diff(ends)), column.values.to_numpy()[ends[0] : ends[-1]]


def _shingled(batch: pa.RecordBatch, name: str, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, shingle) of the abstracts of the pairs that ``which`` marks; all have more words than a shingle."""
    pair, words = _flat(batch, name)
    if len(words) < SHINGLE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = len(words) - SHINGLE + 1
    inside = which[pair[:m]] & (pair[:m] == pair[SHINGLE - 1 :])  # not across the end of an abstract
    return pair[:m][inside], shingles(words)[inside]


def features(batch: pa.RecordBatch, known: Frequent, model: "Matcher | None" = None) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Similarity features of the papers (a_) and records (b_) of a batch, the same as if there were no abstracts, and what
    words (pair, word) only one of two titles has. ``model`` tells which of these speak for another paper."""
    n = batch.num_rows
    sets = {c: (Keyed(*_flat(batch, f"a_{c}"), n), Keyed(*_flat(batch, f"b_{c}"), n)) for c in ("chars", "title", "people", "tokens")}
    both = np.array(batch.column("a_has_abstract").to_numpy(False), bool) & np.array(batch.column("b_has_abstract").to_numpy(False), bool)
    s = np.zeros(n)
    if both.any():
        a, b = (Keyed(*_shingled(batch, f"{p}_words", both), n) for p in "ab")
        common = np.intersect1d(a.keys, b.keys, assume_unique=True)
        whole = a.count(common) / np.maximum(1, np.minimum(a.size, b.size))
        rare, in_a, in_b = (a.count(k[known.rare(k)]) for k in (common, a.keys, b.keys))
        # rare shingles, or all where two texts have more in common than the same phrases give
        s = np.maximum(rare / np.maximum(1, np.minimum(in_a, in_b)), np.where(whole >= 0.35, whole, 0.0))
    a, b = sets["chars"]
    common = a.common(b)
    chars, inside = common / np.maximum(1, a.size + b.size - common), a.share(b)
    a, b = sets["title"]
    content = [Keyed(x.keys[r] >> x.BITS, x.keys[r] & (1 << x.BITS) - 1, n) for x in (a, b) for r in (~np.isin(x.keys & (1 << x.BITS) - 1, known.stop),)]
    tw = np.where((content[0].size > 0) & (content[1].size > 0), content[0].share(content[1]), a.share(b))
    a, b = sets["people"]
    unknown = (a.size == 0) | (b.size == 0)
    people = np.where(unknown, 0.0, a.common(b) / np.maximum(1, b.size))
    years = [np.array(batch.column(f"{p}_year").to_numpy(False), np.float64) for p in "ab"]
    year = np.where(np.isnan(years[0]) | np.isnan(years[1]), 0.0, np.where(np.abs(years[0] - years[1]) <= 1, 1.0, -1.0))
    a, b = sets["tokens"]
    apart = a.apart(b)
    other = model.other(*apart, n) if model else np.zeros(n)
    strange = (~unknown & (people < 0.3)).astype(float)
    x, bare = (np.stack([s * (1 - no), no, chars, inside, tw, people, unknown, other, year, chars * no, inside * no, people * no, other * no, strange * no, np.ones(n)], axis=1) for no in ((~both).astype(float), np.ones(n)))
    return x, bare, apart


def fit(x: np.ndarray, y: np.ndarray, start: np.ndarray, l2: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic classifier by Newton steps, drawn to ``start``; every row counts once."""
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + l2 * (w - start)
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def word_odds(pair: np.ndarray, word: np.ndarray, y: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(words, odds): how much a word that only one of two like titles has speaks for another paper, from 0 to 1.

    A third of the log odds of pairs that aren't a match; words seen in less than ``least`` pairs say nothing.
    """
    words, at = np.unique(word, return_inverse=True)
    yes = np.bincount(at, y[pair], len(words)) if len(words) else np.zeros(0)
    seen = np.bincount(at, minlength=len(words)) if len(words) else np.zeros(0)
    odds = np.log(((seen - yes + 0.5) / (max(1, (1 - y).sum()) + 1)) / ((yes + 0.5) / (max(1, y.sum()) + 1)))
    keep = (seen >= least) & (odds > 0)
    return words[keep], np.minimum(odds[keep] / 3, 1.0)


class Matcher:
    """A trained classifier with calibrated probabilities, and the words that tell papers apart."""

    def __init__(self, weights: np.ndarray = START, scale: tuple[float, float] = (1.0, 0.0), odds: tuple[np.ndarray, np.ndarray] | None = None):
        self.weights, self.scale = weights, scale
        self.odds = odds if odds is not None else (np.zeros(0, np.int64), np.zeros(0))

    def other(self, pair: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
        """How much the words that only one of a pair's titles has speak for another paper: as much as the strongest."""
        out = np.zeros(n)
        if len(self.odds[0]) and len(word):
            at = np.minimum(np.searchsorted(self.odds[0], word), len(self.odds[0]) - 1)
            np.maximum.at(out, pair, np.where(self.odds[0][at] == word, self.odds[1][at], 0.0))
        return out

    @classmethod
    def train(cls, full: np.ndarray, bare: np.ndarray, pair: np.ndarray, word: np.ndarray) -> "Matcher":
        """``full``: features of pairs, ``bare``: of the same pairs without abstracts; words (pair, word) of one title only.

        Pairs whose abstracts agree or don't give the labels: of themselves, and of what they look like without abstracts.
        A third of them is held out for the calibration, on which no other rows and no weights of classes bear.
        """
        both = full[:, NO] == 0
        yes, no = both & (full[:, 0] >= 0.3), both & (full[:, 0] < 0.08)
        y, use = yes.astype(float), yes | no
        hold = np.arange(len(y)) % 3 == 2
        alike = use & ~hold & (bare[:, 2] >= 0.45)
        model = cls(odds=word_odds(pair[alike[pair]], word[alike[pair]], np.where(alike, y, 0.0)) if alike.any() else None)
        full, bare = full.copy(), bare.copy()
        for x in (full, bare):
            x[:, OTHER] = model.other(pair, word, len(y))
            x[:, OTHER_ONLY] = x[:, OTHER] * x[:, NO]
        fitted, held = use & ~hold, use & hold
        model.weights = fit(np.concatenate([full[fitted], bare[fitted]]), np.tile(y[fitted], 2), START)
        if 10 <= y[held].sum() <= held.sum() - 10:
            score = bare[held] @ model.weights
            scale = fit(np.stack([score, np.ones(len(score))], axis=1), y[held], np.array([1.0, 0.0]), 1e-2)
            model.scale = max(float(scale[0]), 0.05), float(scale[1])
        return model

    def confidence(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * (x @ self.weights) + self.scale[1], -30, 30)))


ATTRIBUTES = ["has_abstract", "title", "chars", "tokens", "words", "people", "year"]


def _joined(pairs: DataFrame, papers: DataFrame, others: DataFrame) -> DataFrame:
    rename = lambda df, p: df.select(F.col("rid").alias(f"{p}rid"), *[F.col(c).alias(p + c) for c in ATTRIBUTES])
    return pairs.join(rename(papers, "a_"), "a_rid").join(rename(others, "b_"), "b_rid")


BATCH = 8000  #: pairs compared at a time, fewer than the numbers that a key has room for


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, BATCH) for batch in batches for k in range(0, batch.num_rows, BATCH))


def sample_features(pairs: DataFrame, papers: DataFrame, others: DataFrame, known: Frequent) -> DataFrame:
    """(a_rid, b_rid, x, x_bare, different) of candidate pairs: features with and without abstracts, words of one title only."""
    sent = pairs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            x, bare, (pair, word) = features(batch, sent.value)
            ends = np.searchsorted(pair, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.array(list(v), pa.list_(pa.float64())) for v in (x, bare)]
            yield pa.RecordBatch.from_arrays([batch.column("a_rid"), batch.column("b_rid"), *lists, pa.ListArray.from_arrays(pa.array(ends), pa.array(word))], names=["a_rid", "b_rid", "x", "x_bare", "different"])

    return _joined(pairs, papers, others).mapInArrow(run, "a_rid long, b_rid long, x array<double>, x_bare array<double>, different array<long>")


def scored(pairs: DataFrame, papers: DataFrame, others: DataFrame, known: Frequent, model: Matcher) -> DataFrame:
    """(a_rid, b_rid, confidence) of the candidate pairs that are rather a match than not."""
    sent = pairs.sparkSession.sparkContext.broadcast((known, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = sent.value
        for batch in _parts(batches):
            c = model.confidence(features(batch, known, model)[0])
            yield pa.RecordBatch.from_arrays([batch.column("a_rid"), batch.column("b_rid"), pa.array(c)], names=["a_rid", "b_rid", "confidence"]).filter(pa.array(c >= THRESHOLD))

    return _joined(pairs, papers, others).mapInArrow(run, "a_rid long, b_rid long, confidence double")


def trained(pairs: DataFrame, papers: DataFrame, others: DataFrame, known: Frequent) -> Matcher:
    """A classifier of the pairs of two abstracts, at most SAMPLE, the least by hash."""
    has = lambda df, c: df.filter("has_abstract").select(F.col("rid").alias(c))
    labelled = pairs.join(has(papers, "a_rid"), "a_rid", "left_semi").join(has(others, "b_rid"), "b_rid", "left_semi")
    some = stage(labelled.orderBy(F.xxhash64("a_rid", "b_rid"), "a_rid", "b_rid").limit(SAMPLE), release=True)
    mine = lambda df, c: df.join(F.broadcast(some.select(F.col(c).alias("rid")).distinct()), "rid", "left_semi")
    sampled = stage(sample_features(some.repartition(64, "b_rid"), mine(papers, "a_rid"), mine(others, "b_rid"), known), release=True)
    rows_x = sampled.orderBy(F.xxhash64("a_rid", "b_rid"), "a_rid", "b_rid").select("x", "x_bare", "different").collect()
    x, bare = (np.array([r[i] for r in rows_x]).reshape(-1, len(FEATURES)) for i in (0, 1))
    pair = np.repeat(np.arange(len(rows_x)), [len(r[2]) for r in rows_x])
    return Matcher.train(x, bare, pair, np.array([w for r in rows_x for w in r[2]], np.int64))


def best_of(pairs: DataFrame, papers: DataFrame, others: DataFrame, known: Frequent, model: Matcher, passes: int) -> list[DataFrame]:
    """(b_rid, a_rid, confidence) in parts: the most probable paper of each record that has one.

    Pairs meet the attributes of both sides in ``passes``, each of them all pairs of some records, so that only a share of
    the pairs is on disk with attributes at a time.
    """
    parts = []
    for k in range(passes):
        mine = lambda df, c: df.filter(F.pmod(F.xxhash64(c), F.lit(passes)) == k) if passes > 1 else df  # noqa: E731, B023
        found = scored(mine(pairs, "b_rid"), papers, mine(others, "rid"), known, model)
        best = found.groupBy("b_rid").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "a_rid")).alias("m"))
        parts.append(stage(best.select("b_rid", F.col("m.a_rid").alias("a_rid"), (-F.col("m.c")).alias("confidence")), release=True))
    return parts


def match(papers: DataFrame, others: DataFrame) -> DataFrame:
    """(paper_id, other_table, other_id, confidence): the paper that each record describes, with a calibrated probability.

    papers: (id, title, abstract, authors, year); others: the same with other_table. Rows that agree in all attributes
    are one record, so repeated rows and hot groups of copies are matched once. Records without a title and an abstract
    match nothing; null ids are left out. Of equally probable papers a record takes one of them, always the same.
    """
    cols = ["title", "abstract", "authors", "year"]
    text = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    both = papers.withColumn("other_table", F.lit("")).unionByName(others).filter(F.col("id").isNotNull())
    both = both.select("id", "other_table", *cols, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"), (F.col("other_table") == "").alias("_paper"))
    # a record is told by 128 bits; its number is the first half, mixed with the second
    both = both.withColumn("rid", F.xxhash64("h1", "h2"))
    ids = stage(both.select("_paper", "rid", "other_table", "id").distinct(), release=True)
    side = F.when(F.col("_paper"), "a").otherwise("b").alias("source_name")
    rows = stage(records(both.groupBy(side, "rid").agg(*[F.first(c).alias(c) for c in cols])), release=True)
    often = frequent_shingles(rows.filter("has_abstract"), OFTEN)
    n = rows.count()
    stop = rows.select(F.explode(F.concat("title", "heads")).alias("w")).groupBy("w").count().filter(F.col("count") >= max(3, n * TITLE_STOP)).collect()
    known = Frequent(often, [r[0] for r in stop])
    a, b = rows.filter("source_name = 'a'"), rows.filter("source_name = 'b'")
    keyed = stage(blocks(rows, known), release=True)
    size = int((keyed.agg(F.sum(F.size("keys"))).first()[0] or 0) * KEY_BYTES)
    # the records' parts in turn, as many at a time as have so many pairs that they fit beside the tables
    parts, model, done, share = [], None, 0, max(1, min(PARTS, PARTS * PASS // max(1, n)))
    while done < PARTS:
        last = min(PARTS, done + share)
        pairs = candidates_of(keyed, done, last, max(1, -(-size // max(SLICE_BYTES, n * RECORD_BYTES))))
        if last == PARTS:
            drop(keyed)
        found = pairs.count()
        model = model or trained(pairs, a, b, known)
        parts += best_of(pairs, a, b, known, model, max(1, -(-found // max(PASS, n // 4))))
        drop(pairs)
        share, done = max(1, min(PARTS, int((last - done) * max(PASS, PAIRS * n) / max(1, found)))), last
    drop(rows)
    best = _united(parts)
    pid = ids.filter("_paper").groupBy(F.col("rid").alias("a_rid")).agg(F.min("id").alias("paper_id"))
    other = ids.filter("not _paper").select(F.col("rid").alias("b_rid"), "other_table", F.col("id").alias("other_id"))
    return best.join(pid, "a_rid").join(other, "b_rid").groupBy("paper_id", "other_table", "other_id").agg(F.max("confidence").alias("confidence"))
