import math

import pytest
from pyspark.sql import functions as F
from scholarmill.operators import assembly, retrieval, rows
from scholarmill.functions import vectors


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("a", 1, "w"), (None, 5, "n"), (None, 4, "m")], "k string, o int, v string")
    assert {(r.k, r.v) for r in rows.first_wins(df, ["k"], ["o"]).collect()} == {("a", "w"), (None, "m")}
    assert {(r.k, r.v) for r in rows.last_wins(df, ["k"], ["o"]).collect()} == {("a", None), (None, "n")}
    assert rows.first_wins(df.limit(0), ["k"], ["o"]).count() == 0


def test_numbers_and_batches(spark):
    df = spark.range(1000).withColumn("t", F.repeat(F.lit("x"), (F.col("id") % 7).cast("int")))
    got = {r.id: r.row_no for r in rows.number_rows(df, [F.col("id")]).collect()}
    assert got == {i: i + 1 for i in range(1000)}
    assert {r.id: r.batch for r in rows.batches_of(df, [F.col("id")], 64).collect()} == {i: i // 64 for i in range(1000)}
    assert {r.id: r.part for r in rows.split_into(df, [F.col("id")], 7).collect()} == {i: i // 143 for i in range(1000)}
    before, want = 0, {}
    for i in range(1000):
        want[i] = before // 50
        before += i % 7
    assert {r.id: r.batch for r in rows.batches_by_bytes(df, [F.col("id")], "t", 50).collect()} == want
    assert rows.number_rows(df.limit(0), [F.col("id")]).count() == 0


def test_identify(spark):
    df = spark.createDataFrame([("p1", "arxiv", 0, "a"), ("p2", "ss", 1, "b"), ("p1", "ss", 1, "c"), ("p3", "ss", 1, "a")], "p string, s string, part int, pos string")
    got = {r.p: r.corpus_id for r in rows.identify(df, "p", "s", [F.col("part"), F.col("pos")]).collect()}
    assert got == {"p1": "arxiv-0", "p3": "ss-1", "p2": "ss-2"}


def test_cascade_and_merge(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z"), (4, "q", "x")], "i int, k string, l string")
    one = spark.createDataFrame([("a", "A")], "k string, v string")
    two = spark.createDataFrame([("x", "X"), ("y", "Y")], "l string, v string")
    got = {r.i: (r.v, r.resolved_by) for r in rows.cascade(df, [("one", one, "k"), ("two", two, "l")], "v").collect()}
    assert got == {1: ("A", "one"), 2: ("Y", "two"), 3: (None, None), 4: ("X", "two")}
    p = spark.createDataFrame([("t", None), ("u", "own"), (None, None)], "t string, v string")
    s = spark.createDataFrame([("t", "other"), ("u", "x")], "t string, v string")
    assert {(r.t, r.v) for r in rows.merge_sources(p, s, "t", ["v"]).collect()} == {("t", "other"), ("u", "own"), (None, None)}


def test_samples(spark):
    df = spark.createDataFrame([(1, ["a"] * 9), (2, ["a", "b"]), (3, []), (4, None)], "i int, t array<string>")
    got = {r.i: r.p for r in df.select("i", rows.pick_items(F.col("t"), 4, "s", F.col("i")).alias("p")).collect()}
    assert len(got[1]) == 4 and got[1] == sorted(got[1]) and got[2] == [0, 1] and got[3] == [] and got[4] is None


def brute(vs, qs, k):
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) if any(v) else 0.0 for x in v]
    out = {}
    for q, qv in qs:
        s = sorted(((-round(sum(a * b for a, b in zip(unit(qv), unit(v))), 6) + 0.0, i) for i, v in vs if v), key=lambda t: t)
        out[q] = [i for _, i in s[:k]]
    return out


def test_top_k(spark):
    import random

    random.seed(1)
    vs = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, [0.0] * 8), (301, None)]
    vs += [(400 + i, vs[0][1]) for i in range(20)]  # ties
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>")
    q = df.filter("vec_id % 20 = 0 and vec_id < 300").select(F.col("vec_id").alias("query_id"), "embedding")
    got: dict = {}
    for r in retrieval.top_k_cosine(df, q, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(vs, [(i, v) for i, v in vs if i % 20 == 0 and i < 300], 5)
    assert retrieval.top_k_cosine(df.limit(0), q, 5).count() == 0 and retrieval.top_k_cosine(df, q.limit(0), 5).count() == 0


def test_inverted_file_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in retrieval.top_k_cosine(df, q, 5).collect()}
    index = retrieval.InvertedFile.fit(df)
    got = {(r.query_id, r.vec_id) for r in index.search(df, q, 5, probes=11).collect()}
    assert len(exact & got) / len(exact) >= 0.9
    assert index.assign(df).filter(F.size("lists") == 1).count() == df.count()


def test_bm25(spark):
    docs = [(i, t) for i, t in enumerate(["a b c", "a a d", "e f", "", None, "d e a", "g", "h", "k"])]
    asked = [(1, "a d"), (2, "zz"), (3, "f f")]
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")).collect()}
    terms = [[t for t in (x or "").split(" ") if t] for _, x in docs]
    n, mean = len(docs), sum(map(len, terms)) / len(docs)
    df = {t: sum(t in ts for ts in terms) for t in {t for ts in terms for t in ts}}
    idf = {t: math.log(n - v + 0.5) - math.log(v + 0.5) for t, v in df.items()}
    floor = sum(idf.values()) / len(idf) * 0.25
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    for q, text in asked:
        for i, ts in enumerate(terms):
            s = sum(idf.get(t, 0) * ts.count(t) * 2.5 / (ts.count(t) + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for t in text.split() if t in ts)
            assert got.get((q, i), 0) == pytest.approx(s, abs=2e-6)
    best = retrieval.best_document(retrieval.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string"))).collect()
    assert {r.query_id: r.doc_id for r in best} == {1: 1, 3: 2}
    matrix = retrieval.bm25_best(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, text string")).collect()
    assert sorted(matrix) == sorted(best)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [r.u for r in df.select(vectors.l2_normalize(F.col("v")).alias("u")).collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    p = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 1.0]], [0])], "v array<array<float>>, m array<int>")
    assert [r.o for r in p.select(vectors.mean_pool(F.col("v"), F.col("m")).alias("o")).collect()] == [[2.0, 4.0], None]


def test_segments(spark):
    count = lambda s: len(s.split())
    assert assembly.segment(["a b", "c", "d e f", "g"], 3, count) == [["a b", "c"], ["d e f"], ["g"]]
    assert assembly.segment(["a", "b c d e", "f"], 3, count) == [["a"], ["b c d e"], ["f"]]
    assert assembly.segment(["a", "b c d e", "f"], 3, count, keep_long=False) == [["a"]]
    df = spark.createDataFrame([(1, "a b <|cite_1|> c d <|cite_2|>"), (2, "x y"), (3, ""), (4, None)], "i int, t string")
    got = [(r.i, r.part, r.paper, r.n_tokens) for r in assembly.segments(df, "i", "t", 3).orderBy("i", "part").collect()]
    assert got == [(1, 0, "a b<|cite_1|>", 2), (1, 1, "c d<|cite_2|>", 2), (2, 0, "x y", 2)]


def test_fill_mask_faults(spark):
    df = spark.createDataFrame([("a <|cite_1|> b", [("<|cite_1|>", "X")]), ("a", None)], "t string, e array<struct<token:string,value:string>>")
    assert [r.o for r in df.select(assembly.fill_tokens(F.col("t"), F.col("e")).alias("o")).collect()] == ["a X b", "a"]
    m = spark.createDataFrame([(["a", "<|cite_start|>", "b", "<|cite_end|>", "c"],), ([],)], "w array<string>")
    assert [r.o for r in m.select(assembly.label_mask(F.col("w")).alias("o")).collect()] == [[True, True, False, False, True], []]
    span = "<|cite_start|>x<|cite_end|>"
    t = spark.createDataFrame([(span * 4, ["a"] * 4, [0, 1, 2, 3]), (span, ["a", None], [5]), (None, None, None)], "p string, t array<string>, i array<int>")
    got = [r.f for r in t.select(assembly.training_row_faults(F.col("p"), F.col("t"), F.col("i")).alias("f")).collect()]
    assert got == [[], ["targets", "indexes", "few_spans", "out_of_range", "null_target"], ["targets", "indexes", "few_spans"]]


def test_stages_are_cleared(spark):
    from pathlib import Path

    from scholarmill.plans.stage import clear_stages, shared_dir, stage

    assert stage(spark.range(5)).count() == 5
    at = Path(shared_dir(spark).removeprefix("file://"))
    assert any(at.glob("stage-*")) and clear_stages(spark) > 0 and not any(at.glob("stage-*"))


def test_segments_go_back_to_their_last_citation():
    from scholarmill.operators.assembly import segment_back

    count, cited = (lambda s: len(s.split())), (lambda s: s.startswith("<|"))
    cut = ["a b c", "<|cite_1|>", "d e", "<|cite_2|>", "f g h", "i j"]
    assert segment_back(cut, 9, count, cited) == [["a b c", "<|cite_1|>", "d e", "<|cite_2|>"], ["f g h", "i j"]]
    assert segment_back(cut, 5, count, cited) == [["a b c", "<|cite_1|>"], ["d e", "<|cite_2|>"], ["f g h", "i j"]]
    assert segment_back(["a b", "c d", "e f g h i j", "k"], 4, count, cited) == [["a b", "c d"], ["e f g h i j"], ["k"]]
    assert segment_back([], 5, count, cited) == []


def test_marker_places_and_last_tokens(spark):
    from scholarmill.functions.vectors import last_token_pool

    df = spark.createDataFrame([(["<|cite_start|>", "x", "<|cite_start|>"], [1, 0, 5]), ([], [0]), (None, [0])], "w array<string>, k array<int>")
    rows = df.select(assembly.marker_positions(F.col("w"), "<|cite_start|>").alias("a"), assembly.marker_positions(F.col("w"), "<|cite_start|>", F.col("k")).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [([0, 2], [2, 0, None]), ([], [None]), (None, [None])]
    df = spark.createDataFrame([([[1.0], [2.0], [3.0]], [1, 1, 0]), ([[1.0]], [0]), (None, None)], "v array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(last_token_pool(F.col("v"), F.col("m"))).collect()] == [[2.0], None, None]


def test_loss_leaves_out_null_vectors(spark):
    from scholarmill.operators.retrieval import softmax_loss

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, None), (5, [1.0])], "vec_id long, embedding array<float>")
    got = {r.query_id: (round(r.best, 4), round(r.loss, 4)) for r in softmax_loss(v, v.withColumnRenamed("vec_id", "query_id"), 0.5).collect()}
    near = round(math.log(1 + math.exp(-2 * 0.707107)), 4)
    assert got == {1: (0.7071, near), 2: (0.7071, near), 3: (0.7071, 0.6931)}


def test_stage_tables_need_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from scholarmill.plans import stage

    unset = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            stage.shared_dir(unset(master))
    assert stage.shared_dir(unset("local[2]")).startswith("file:///")
