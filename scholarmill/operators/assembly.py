"""Assembly of training rows: tokens filled in, papers segmented by a token budget, targets sampled, rows checked."""

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarmill.functions.cite import split_with_citations
from scholarmill.functions.latex import let


def count_tokens(c: Column) -> Column:
    """Tokens between white space; another counter can be given where a tokenizer is at hand."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t != ""))


def fill_tokens(text: Column, entries: Column) -> Column:
    """The text with the value of each (token, value) entry in place of the token, in the entries' order."""
    return F.aggregate(F.coalesce(entries, F.array().cast("array<struct<token:string,value:string>>")), text, lambda acc, e: F.replace(acc, e.token, F.coalesce(e.value, F.lit(""))))


def segment(pieces: list[str], budget: int, count: Callable[[str], int], keep_long: bool = True) -> list[list[str]]:
    """Runs of pieces of at most ``budget`` tokens: a piece that doesn't fit begins the next run.

    A piece over the budget by itself is a run of its own; without ``keep_long`` it ends the walk, as the written rule
    has it, and the rest is lost.
    """
    out: list[list[str]] = []
    run: list[str] = []
    used = 0
    for p in pieces:
        n = count(p)
        if n > budget and not keep_long:
            break
        if run and used + n > budget:
            out.append(run)
            run, used = [], 0
        run.append(p)
        used += n
    return out + ([run] if run else [])


def segments(df: DataFrame, key: str, text: str, budget: int, keep_long: bool = True, counter: Callable[[str], int] | None = None, back: bool = False) -> DataFrame:
    """(key, part, n_parts, paper, n_tokens): each text's segments, cut between texts and citation tokens.

    A text within the budget is one segment, unchanged; null and empty texts have none. Pieces of a segment are joined
    without blanks. With ``back`` a segment ends behind its last citation token.
    """
    citation = re.compile(r"<\|(?:cite_\d+|multi_cite_\d+_\d+)\|>")
    cut_up = (lambda cut: segment_back(cut, budget, count, citation.fullmatch)) if back else (lambda cut: segment(cut, budget, count, keep_long))
    count = counter or (lambda s: len(s.split()))
    kind = dict(df.dtypes)[key]
    rows = df.select(F.col(key), F.col(text).alias("_text"), split_with_citations(F.col(text)).alias("_pieces")).filter(F.length("_text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "part", "n_parts", "paper", "n_tokens")}
            for i, (whole, cut) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = [whole] if count(whole) <= budget else ["".join(r) for r in cut_up(cut)]
                for n, s in enumerate(found):
                    for c, v in zip(out, (i, n, len(found), s, count(s))):
                        out[c].append(v)
            kinds = {"paper": pa.string()}
            cols = [batch.column(0).take(pa.array(out.pop("row"), pa.int64()))] + [pa.array(v, kinds.get(c, pa.int32())) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *out])

    return rows.mapInArrow(run, f"`{key}` {kind}, part int, n_parts int, paper string, n_tokens int")


def training_row_faults(paper: Column, targets: Column, targets_idx: Column) -> Column:
    """What is wrong with a training row, as an array of names; empty for a sound row."""
    n = lambda marker: F.regexp_count(F.coalesce(paper, F.lit("")), F.lit(marker))
    starts, ends = n(r"<\|cite_start\|>"), n(r"<\|cite_end\|>")
    faults = {
        "targets": F.coalesce(F.size(targets), F.lit(-1)) != 4,
        "indexes": F.coalesce(F.size(targets_idx), F.lit(-1)) != 4,
        "few_spans": (starts < 4) | (ends < 4),
        "unpaired": starts != ends,
        "out_of_range": F.coalesce(F.exists(targets_idx, lambda i: i >= starts), F.lit(False)),
        "null_target": F.coalesce(F.exists(targets, lambda t: t.isNull()), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in faults.items()]), lambda x: x.isNotNull())


def label_mask(tokens: Column) -> Column:
    """For each token whether it is a label: tokens from behind a start marker to the end marker, this included, are not.

    Made in the JVM from the markers' places: up to the next marker all tokens have what the last one says. Null gives null.
    """
    placed = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("t"))), lambda m: m.t.isin("<|cite_start|>", "<|cite_end|>"))
    first = F.array(F.struct(F.lit(-1).alias("i"), F.lit("").alias("t")))
    runs = lambda marks: F.flatten(F.transform(marks, lambda m, k: F.array_repeat(m.t != "<|cite_start|>", F.coalesce(F.get(marks, k + 1).i, F.size(tokens) - 1) - m.i)))
    return let(F.concat(first, placed), runs)


def marker_positions(tokens: Column, marker: str, picks: Column | None = None) -> Column:
    """The places (from 0) of a marker among tokens, or those of its occurrences that ``picks`` names, null where there is none."""
    places = F.filter(F.transform(tokens, lambda t, i: F.when(t == marker, i)), lambda i: i.isNotNull())
    return places if picks is None else F.transform(picks, lambda k: F.get(places, k))


def segment_back(pieces: list[str], budget: int, count: Callable[[str], int], is_citation: Callable[[str], bool]) -> list[list[str]]:
    """Runs of pieces of at most ``budget`` tokens that end with a citation: a run that is full goes back to its last one.

    What is behind that citation opens the next run. A run without a citation ends where it is full; a piece over the
    budget is a run of its own.
    """
    out: list[list[str]] = []
    run: list[str] = []
    sizes: list[int] = []
    queue = list(reversed(pieces))
    while queue:
        p = queue.pop()
        n = count(p)
        if run and sum(sizes) + n > budget:
            last = max((i for i, x in enumerate(run) if is_citation(x)), default=len(run) - 1)
            back = run[last + 1 :]
            out.append(run[: last + 1])
            queue += [p, *reversed(back)]
            run, sizes = [], []
            continue
        run.append(p)
        sizes.append(n)
    return out + ([run] if run else [])
