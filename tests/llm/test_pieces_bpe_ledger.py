import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from scholarmill.llm import bpe, ledger, pieces


def joined(text, cuts, overlap):
    parts = [text[: cuts[0]]] + [text[c - overlap : d] for c, d in zip(cuts, [*cuts[1:], len(text)])] if cuts else [text]
    assert parts[0] + "".join(p[overlap:] for p in parts[1:]) == text
    return parts


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "longerword ", "end. ", "para.\n\n", "<|cite_start|> (Reference: a b c. d) <|cite_end|> ", "x" * 30, "é"]), max_size=200), st.integers(40, 120), st.integers(0, 30))
def test_cuts_hold_every_limit(words, limit, overlap):
    text = "".join(words)
    parts = joined(text, pieces.cut_points(text, limit, overlap), overlap)
    assert all(len(p) <= limit for p in parts)
    assert len(text) > limit or len(parts) == 1


def test_cuts_are_natural_and_outside_spans():
    text = ("A sentence of some words here. " * 8 + "\n\n") * 20
    cuts = pieces.cut_points(text, 1000, 50)
    assert all(text[:c].endswith("\n\n") for c in cuts)
    span = "<|cite_start|> (Reference: " + "one two. " * 20 + ") <|cite_end|> "
    text = ("Some words. " * 5 + span) * 30
    for c in pieces.cut_points(text, 600, 60):
        assert not any(m.start() < c < m.end() for m in pieces.SPAN.finditer(text))
    assert pieces.cut_points("x" * 2000, 600, 60) and pieces.cut_points("", 5, 1) == []
    with pytest.raises(ValueError):
        pieces.cut_points("abc", 5, 5)


def test_split_items(spark):
    rows = [(1, "a " * 40, ["b " * 40, None, "short"], "clash"), (1, "a " * 40, ["b " * 40, None, "short"], "clash"), (2, None, None, "x"), (3, "", [], "y"), (4, "z" * 50_000, ["ok"], "q")]
    df = spark.createDataFrame(rows, "row_id long, paper string, targets array<string>, text string")
    items = pieces.split_items(df, {"paper": (50, 10), "targets": (50, 10)})
    assert {(r.row_id, r.field, r.item_no) for r in items.collect()} == {(1, "paper", 0), (1, "targets", 0), (4, "paper", 0)}
    cut: dict = {}
    for r in pieces.pieces(items).distinct().orderBy("row_id", "field", "piece_no").collect():
        cut.setdefault((r.row_id, r.field), []).append(r.piece)
    assert all(len(p) <= 50 for ps in cut.values() for p in ps)
    assert cut[1, "paper"][0] + "".join(p[10:] for p in cut[1, "paper"][1:]) == "a " * 40
    assert pieces.split_items(df.limit(0), {"paper": (50, 10)}).count() == 0


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder.load()


def test_tokens_equal_the_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers as P

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(5)
    alphabet = "abcde  \n\t.,'ÄßéЖ中🙂0123<|endoftext|>"
    texts = ["", "<|endoftext|>", "a" * 3000, " " * 2000, "ab" * 1500, "it's 12,345.67 naïve\u200b", *("".join(rng.choices(alphabet, k=rng.randint(1, 400))) for _ in range(200))]
    assert encoder.encode(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode([None, ""]) == [[], []]


def test_encode_column(spark, encoder):
    df = spark.createDataFrame([(1, "hello world", 9), (1, "hello world", 9), (2, "", 9), (3, None, 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text", encoder).collect())
    ids = encoder.encode(["hello world"])[0]
    assert got == [(1, ids), (1, ids), (2, []), (3, [])]
    assert bpe.encode_column(df.limit(0), "doc_id", "text", encoder).count() == 0


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "corpus_id string, title string, abstract string, keep_id string")
    return ledger.corpus_keys(df)


def test_ledger_of_two_batches_equals_one(spark):
    a = [("c3", "A  Title!", "Text.", "k"), ("c1", "a title", "TEXT", "k"), ("c1", "a title", "TEXT", "k"), ("c9", None, None, "k"), ("c5", "A", None, "k")]
    b = [("c0", "“A Title”", "te xt", "k"), ("c8", None, None, "k"), ("c7", "a", "", "k"), ("c6", "a1", None, "k"), ("c2", "á title", "text", "k")]
    book = ledger.add_batch(ledger.add_batch(ledger.empty_ledger(spark), rows_of(spark, a)), rows_of(spark, b))
    both = rows_of(spark, a + b)
    once = ledger.add_batch(ledger.empty_ledger(spark), both)
    assert sorted(map(tuple, book.collect())) == sorted(map(tuple, once.collect()))
    got = {(r.keep_id, r.dup_id): r.copies for r in ledger.members(book, both).collect()}
    assert got == {("c0", "c1"): 4, ("c0", "c3"): 4, ("c8", "c9"): 2}
    assert ledger.members(ledger.empty_ledger(spark), both.limit(0)).count() == 0


def test_only_touched_buckets_are_written(spark):
    book = ledger.add_batch(ledger.empty_ledger(spark), rows_of(spark, [(f"c{i}", f"t{i}", None, "k") for i in range(300)]))
    old = {f.rpartition("/")[0] for f in book.inputFiles()}
    more = ledger.add_batch(book, rows_of(spark, [("a", "T 1", None, "k"), ("b", "T-1", None, "k")]))
    new = {f.rpartition("/")[0] for f in more.inputFiles()} - old
    assert len(old) > 50 and len(new) == 1 and "source_name=corpus_data/bucket=" in new.pop()
    assert {r.keep_id: r.copies for r in more.filter("copies > 1").collect()} == {"a": 3} and more.count() == 300


def test_hot_group_takes_the_bounded_path(spark, monkeypatch):
    monkeypatch.setattr(ledger, "HOT_LEAST", 3)
    df = spark.range(300).select(F.format_string("c%04d", "id").alias("corpus_id"), F.when(F.col("id") % 3 == 0, "Hot Title").otherwise(F.concat(F.lit("t"), F.col("id") % 150)).alias("title"), F.lit(None).cast("string").alias("abstract"))
    rows = ledger.corpus_keys(df)
    got = {(r.keep_id, r.dup_id) for r in ledger.members(ledger.add_batch(ledger.empty_ledger(spark), rows), rows).collect()}
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r.title, []).append(r.corpus_id)
    assert got == {(min(g), x) for g in groups.values() for x in g if x != min(g)}


def test_lookup_payloads(spark):
    full = '{"paperId":"AB","title":"T","abstract":null,"url":"u/1","matchScore":1.50}'
    rows = [(1, full), (2, '{ "matchScore": 1.5, "url": "U 1", "paperId": "ab", "title": "t!", "abstract": null}'), (3, full[:-9]), (4, None), (5, ""), (6, full.replace("1.50", "1.51")), (7, full.replace("null", '""'))]
    keys = ledger.lookup_keys(spark.createDataFrame(rows, "raw_id long, payload string"))
    groups: dict = {}
    for r in keys.collect():
        groups.setdefault((r.h1, r.h2), []).append(r.record_id)
    assert sorted(map(sorted, groups.values())) == [["1", "2"], ["6"], ["7"]]
