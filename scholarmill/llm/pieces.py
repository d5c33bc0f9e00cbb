"""Splitting oversized texts at natural boundaries, with balanced targets.

The least number of pieces is computed, targets of equal length are placed, each is snapped to the strongest boundary
near it (paragraph, sentence, word), and a piece is added whenever a limit fails. No cut lies inside a citation span
unless the span alone exceeds what a piece can hold.
"""

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = re.compile(r"<\|cite_start\|>.*?<\|cite_end\|>", re.S)
#: The boundaries from strong to weak; a cut lies behind the match.
BOUNDARIES = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"[.!?][\"'”’)\]]*\s+|[。！？][”’」）]*\s*"), re.compile(r"\s+"))


def _outside(cuts: list[int], spans: list[tuple[int, int]]) -> list[int]:
    """Those of the ascending ``cuts`` that lie strictly inside no span."""
    if not spans:
        return cuts
    starts = np.array([a for a, _ in spans])
    ends = np.array([b for _, b in spans])
    c = np.array(cuts, np.int64)
    k = np.searchsorted(starts, c, "left") - 1
    return c[(k < 0) | (c >= ends[np.maximum(k, 0)])].tolist()


def cut_points(text: str, limit: int, overlap: int) -> list[int]:
    """Where ``text`` is cut: the k-th later piece is text[c - overlap : next c], and no piece exceeds ``limit``.

    An empty list where the text is within the limit. Joining the first piece with the later ones without their first
    ``overlap`` characters gives the text again.
    """
    n = len(text)
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    if n <= limit:
        return []
    step = limit - overlap
    spans = [m.span() for m in SPAN.finditer(text)]
    levels = [_outside([m.end() for m in b.finditer(text)], spans) for b in BOUNDARIES]

    def inside(c: int) -> bool:
        k = bisect.bisect_left(spans, (c, -1)) - 1
        return k >= 0 and c < spans[k][1]

    def snap(target: int, low: int, high: int) -> int:
        """The strongest boundary in [low, high], of equal ones the nearest to ``target``."""
        for cuts in levels:
            i = bisect.bisect_left(cuts, target)
            near = [c for c in cuts[max(0, i - 1) : i + 1] if low <= c <= high]
            if near:
                return min(near, key=lambda c: (abs(c - target), c))
        return 0

    least = 1 + -(-(n - limit) // step)
    for k in range(least, 2 * least + 4):
        size = (n + (k - 1) * overlap) / k
        slack = max(limit - size, limit / 5)
        cuts: list[int] = []
        for j in range(1, k):
            start = cuts[-1] - overlap if cuts else 0
            target = round(size + (j - 1) * (size - overlap))
            low, high = max(start + overlap + 1, round(target - slack)), min(start + limit, round(target + slack), n - 1)
            c = snap(min(target, high), low, high) if low <= high else 0
            if not c:
                break
            cuts.append(c)
        if len(cuts) == k - 1 and n - (cuts[-1] - overlap) <= limit:
            return cuts
    # with twice the pieces no even layout holds, as a span or word fills a piece: take the strongest boundary of the last
    # half of what each piece can hold
    cuts = []
    while n - (start := cuts[-1] - overlap if cuts else 0) > limit:
        top = min(start + limit, n - 1)
        least_cut = start + overlap + 1
        c = snap(top, max(least_cut, start + overlap + step // 2), top) or snap(top, least_cut, top)
        if not c:
            c = top
            while c > least_cut and inside(c):
                c -= 1
            if inside(c):
                c = top
        cuts.append(c)
    return cuts


def with_cuts(df: DataFrame, text: str, limit: str, overlap: str, cuts: str = "cuts") -> DataFrame:
    """``df`` with the column ``cuts``: where the column ``text`` is cut. A null text has none.

    limit and overlap name integer columns of ``df``.
    """
    names = df.columns
    t, li, ov = (names.index(c) for c in (text, limit, overlap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [cut_points(x, a, b) if x else [] for x, a, b in zip(*(batch.column(i).to_pylist() for i in (t, li, ov)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*names, cuts])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(cuts, T.ArrayType(T.IntegerType()))]))


def oversized(df: DataFrame, fields: dict[str, tuple[int, int]], key: str = "row_id") -> DataFrame:
    """(key, field, item_no, text, size_limit, size_overlap): the items of ``df`` over their limit.

    ``fields`` gives limit and overlap of each field; a string field is item 0, an array field has an item for each of
    its elements, numbered from 0. Null and empty texts and elements are within any limit.
    """
    kinds = dict(df.dtypes)

    shape = "array<struct<field:string,item_no:int,text:string,size_limit:int,size_overlap:int>>"

    def over(name: str, limit: int, overlap: int) -> Column:
        items = F.col(name) if kinds[name].startswith("array") else F.array(F.col(name))
        entry = lambda x, i: F.struct(F.lit(name).alias("field"), i.cast("int").alias("item_no"), x.alias("text"), F.lit(limit).alias("size_limit"), F.lit(overlap).alias("size_overlap"))
        # built for the items over the limit only; most rows have none
        found = F.filter(F.transform(items, lambda x, i: F.when(F.length(x) > limit, entry(x, i))), lambda x: x.isNotNull())
        return F.coalesce(found.cast(shape), F.array().cast(shape))

    parts = [over(name, limit, overlap) for name, (limit, overlap) in fields.items()]
    return df.select(F.col(key), F.explode(F.concat(*parts)).alias("_item")).select(key, "_item.*")


def split_items(df: DataFrame, fields: dict[str, tuple[int, int]], key: str = "row_id") -> DataFrame:
    """(key, field, item_no, text, size_overlap, cuts) of each item over its limit; rows repeat as in ``df``."""
    return with_cuts(oversized(df, fields, key), "text", "size_limit", "size_overlap")


def pieces(items: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, field, item_no, piece_no, n_pieces, piece) of the result of ``split_items``, cut inside the JVM."""
    n = F.size("cuts")
    start = lambda i: F.when(i == 0, 0).otherwise(F.get("cuts", i - 1) - F.col("size_overlap"))
    end = lambda i: F.coalesce(F.get("cuts", i), F.length("text"))
    every = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("piece_no"), F.substring(F.col("text"), start(i) + 1, end(i) - start(i)).alias("piece")))
    return items.select(key, "field", "item_no", (n + 1).alias("n_pieces"), F.explode(every).alias("_p")).select(key, "field", "item_no", "_p.piece_no", "n_pieces", "_p.piece")
