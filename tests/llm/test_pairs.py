import random
import time

import numpy as np
from pyspark.sql import functions as F
from scholarmill.llm import entities, fmindex, leaks, lookalike, overlap
from scholarmill.llm.words import words
from scholarmill.plans import stage

VOCAB = [a + b for a in ("ka", "lo", "mi", "zu", "re", "to") for b in ("ban", "dor", "fel", "gis", "tun", "vik", "wen", "xal")]


def test_fm_index_against_scan():
    rng = np.random.default_rng(3)
    seq = np.concatenate([rng.integers(1, 6, 400), np.tile([2, 3, 4], 60)]).astype(np.int32)
    index = fmindex.FMIndex(seq, 6, sample=5)
    phrases = np.array([seq[i : i + 3] for i in range(0, 500, 7)] + [[6, 6, 6], [1, 6, 1]], np.int32)
    low, high = index.search(phrases)
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_marks_of_any_length_are_no_words():
    cite = "[" + ", ".join(str(i) for i in range(1, 60)) + "]"
    tag = '<a href="' + "x" * 500 + '" class=y>'
    assert words(f"one {cite} two {tag}three</a> <|{'t' * 90}|> four <b>a</b>") == ["one", "two", "three", "four", "a"]
    assert words("if x <y then 5 > 3") == ["if", "x", "y", "then", "5", "3"]


def noisy(rng, w, share):
    out = []
    for x in w:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(rng.choice(VOCAB) if r < share * 2 / 3 else x)
        if r > 1 - share / 3:
            out.append(rng.choice(VOCAB))
    return out


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choices(VOCAB, k=rng.randint(10, 70)))) for i in range(40)]
    line = "Read the following passage with care and say which of the works below fits it best:"
    items = [(i, f"{line}\n\n{t}" if i % 2 else t) for i, t in items] + [(40, None), (41, ""), (42, items[0][1].upper())]
    docs = []
    for d in range(120):
        w = rng.choices(VOCAB, k=rng.randint(0, 120))
        if d % 3 == 0:
            own = words(items[d % 40][1])[-70:]
            n = rng.choice([8, 12, 30, 60])
            w[len(w) // 2 : len(w) // 2] = noisy(rng, own[-n:], rng.choice([0, 0.04]))
        text = " ".join(x.upper() + "," if rng.random() < 0.1 else x for x in w)
        docs.append((d, (line + " " if d % 5 == 0 else "") + text.replace(" ", "~\\cite{k} ", 1), "x"))
    docs += [(200, None, "x"), (201, "", "x"), (202, " ".join(docs[0][1] for _ in range(30)), "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, i) for r in leaks.leaks(df, "doc_id", "text", it, "item_id", "text").collect() for i in r.item_ids}
    want = set()
    for i, t in items:
        seq = words(t)
        seq = seq[len(words(line)) :] if t and t.startswith("Read the") else seq
        for d, text, _ in docs:
            if len(seq) >= 18 and leaks.runs(seq, words(text)):
                want.add((d, i))
    assert want and got == want
    assert leaks.leaks(df.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0
    assert leaks.leaks(df, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0


def test_runs_with_three_edits_in_twenty_words_are_found():
    rng = random.Random(21)
    found = 0
    for _ in range(300):
        seq = [rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(40)]
        run = seq[10:30]
        for i in rng.sample(range(1, 19), 3):
            run[i] = "changed"
        doc = rng.choices(VOCAB, k=30) + run + rng.choices(VOCAB, k=30)
        hits = leaks.search_shard(leaks.Shard([rng.choices(VOCAB, k=50), doc]), leaks.Passages([(7, " ".join(seq))], set()))
        assert leaks.runs(seq, doc)
        found += any(d == 1 for d, *_ in hits)
    assert found == 300


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(8)
    for seq in (rng.integers(1, 4, 300), np.tile([1, 2], 200), np.ones(50, np.int64), rng.integers(1, 70_000, 500), np.array([1])):
        seq = np.append(seq, 0).astype(np.int32)
        want = sorted(range(len(seq)), key=lambda i: seq[i:].tolist())
        assert fmindex.suffix_array(seq).tolist() == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_words():
    rng = random.Random(1)
    for _ in range(50):
        a, b = (np.array(rng.choices(range(9), k=rng.randint(0, 60)), np.int32) for _ in range(2))
        assert overlap.common_words(a, b) == lcs(a.tolist(), b.tolist())


def test_overlaps_against_brute_force(spark):
    rng = random.Random(9)
    base = [rng.choices(VOCAB, k=rng.randint(3, 150)) for _ in range(40)]
    rows = []
    for i in range(160):
        w = base[i % 40] if i < 80 else noisy(rng, base[i % 40], rng.choice([0.02, 0.05, 0.1, 0.2]))
        rows.append((i, rng.choice(["train", "dev", "test"]), "  ".join(w).upper() if i % 7 == 0 else " ".join(w) + ".", "x"))
    rows += [rows[3], (900, "train", None, "x"), (901, "dev", "", "x"), (902, "dev", "...", "x"), (903, None, rows[0][2], "x"), (904, "dev", "one", "x"), (905, "train", "ONE!", "x")]
    rows += [(1000 + i, "train" if i % 2 else "test", "the same hot text " * 10, "x") for i in range(12)]
    df = spark.createDataFrame(rows, "row_id long, split string, paper string, words string").withColumn("is_eval", F.col("split") != "train")
    got = {(r.id_a, r.id_b) for r in overlap.overlaps(df, "row_id", "paper", "is_eval").collect()}
    cut = {r[0]: (r[1], overlap.WORD.findall(r[2].lower())) for r in rows if r[1] and r[2]}
    want = set()
    for a, (sa, wa) in cut.items():
        for b, (sb, wb) in cut.items():
            if a < b and wa and wb and (sa == "train") != (sb == "train"):
                n = max(len(wa), len(wb))
                if lcs(wa, wb) >= n - overlap.edits(n):
                    want.add((a, b))
    assert want and got == want
    assert overlap.overlaps(df.limit(0), "row_id", "paper", "is_eval").count() == 0


def test_prefixes_share_a_shingle_after_drops_and_additions():
    rng = random.Random(5)
    nothing = (np.zeros(0, np.int32), np.zeros(0, np.int32))
    for n in (100, 150, 200):
        for _ in range(150):
            a = list(range(1000, 1000 + n))
            e = n // 10
            gone = set(rng.sample(range(n), e))
            b = [w for i, w in enumerate(a) if i not in gone]
            for k in range(e):  # added words are rare, those of the text frequent
                b.insert(rng.randint(0, len(b)), 5000 + k)
            assert lcs(a, b) >= n - overlap.edits(n)
            x, y = (np.array(w, np.int32) for w in (a, b))
            common = (x, np.full(n, 100, np.int32))
            (hx, px), (hy, py) = (overlap.prefix(w, common, (np.zeros(0, np.int64), nothing[1])) for w in (x, y))
            at = dict(zip(hx.tolist(), px.tolist()))
            assert any(h in at and abs(at[h] - p) <= e for h, p in zip(hy.tolist(), py.tolist()))


def test_consistent_forms():
    same = ["Naïve Trajectories at Scale", "Nai\u0308ve Trajеctοries at Scale", "Naïve\u2003Traj\u00adectories\u200b at Ｓｃａｌｅ", "Naïve Τrajectorieѕ at Ѕсаlе"]
    assert len({lookalike.consistent(s) for s in same}) == 1
    for a, b in [("Naive", "Naïve"), ("a-b", "a–b"), ("x²", "x2"), ("Title", "title"), ("λ-net", "l-net"), ("a, b", "a b")]:
        assert lookalike.consistent(a) != lookalike.consistent(b)
    assert lookalike.consistent("ﬁne ﬂow") == "fine flow" and lookalike.consistent("Α Study") == "A Study"
    assert lookalike.consistent("a mօdel Oո Scale") == "a model On Scale" and lookalike.consistent("Ꭺ Study of Graphs") == "A Study of Graphs"
    assert lookalike.consistent("Ցանկացած մարդ ազատ է") == "Ցանկացած մարդ ազատ է"
    assert lookalike.consistent("всё xорошо сегодня") == lookalike.consistent("всё хорошо сегодня")
    assert lookalike.consistent(None) is None and lookalike.consistent("") == "" and lookalike.consistent("日本語 テスト") == "日本語 テスト"
    assert lookalike.resolved("Trаnslate") == frozenset() and lookalike.resolved("123") is None
    long = "Ѕ" + "a" * 200_000
    assert lookalike.consistent(long) == "S" + "a" * 200_000


def test_same_look(spark):
    left = spark.createDataFrame([("a", "Ｔitle", 1), ("a", "Ｔitle", 1), ("b", "Title", 1), ("c", None, 1), ("d", "", 1), ("e", "other", 1)], "k string, t string, form int")
    right = spark.createDataFrame([(1, "Title"), (2, "Тitle"), (3, None), (4, "title")], "k long, t string")
    got = {(r.left_id, r.right_id) for r in lookalike.same_look(lookalike.forms(left, "k", "t", "f"), lookalike.forms(right, "k", "t", "f")).collect()}
    assert got == {("a", "1"), ("a", "2"), ("b", "2")}
    assert lookalike.same_look(lookalike.forms(left.limit(0), "k", "t", "f"), lookalike.forms(right, "k", "t", "f")).count() == 0


def test_match_entities(spark):
    rng = random.Random(2)
    papers, others, truth = [], [], set()
    for i in range(60):
        title = " ".join(x + y for x, y in zip(rng.sample(VOCAB, 5), rng.sample(VOCAB, 5)))
        abstract = " ".join(rng.choices(VOCAB, k=60))
        name = f"{rng.choice(VOCAB)}{rng.choice(VOCAB)}"
        papers.append((f"p{i}", title, abstract if i % 10 else None, f"Ann {name.title()}", 2015))
        if i % 2:
            typo = title[:3] + title[4:]
            w = noisy(rng, abstract.split(), 0.05)
            others.append(("t", f"o{i}", typo.upper(), " ".join(w) if i % 3 else None, f"{name.title()}, Ann", 2015))
            truth.add((f"p{i}", f"o{i}"))
        else:
            others.append(("t", f"s{i}", title + " II", " ".join(rng.choices(VOCAB, k=60)), "Bob Otherman", 2021))
    others += [others[1], ("t", None, "x", None, None, None), ("t", "n1", None, None, None, None), ("t", "n2", "", "", "", None)]
    p = spark.createDataFrame(papers + [papers[0], ("pn", None, None, None, None)], "id string, title string, abstract string, authors string, year int")
    o = spark.createDataFrame(others, "other_table string, id string, title string, abstract string, authors string, year int")
    rows = entities.match(p, o).collect()
    got = {(r.paper_id, r.other_id) for r in rows}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 1
    assert all(0.5 <= r.confidence <= 1 for r in rows)
    assert entities.match(p.limit(0), o).count() == 0 and entities.match(p, o.limit(0)).count() == 0


def titled(rng, n):
    return [" ".join(x + y for x, y in zip(rng.sample(VOCAB, 5), rng.sample(VOCAB, 5))) for _ in range(n)]


PAPER, OTHER = "id string, title string, abstract string, authors string, year int", "other_table string, id string, title string, abstract string, authors string, year int"


def test_titles_of_frequent_words_match(spark):
    rng = random.Random(6)
    titles = titled(rng, 30)
    papers = [(f"p{i}", t, " ".join(rng.choices(VOCAB, k=60)), "Ann Lobanfel", 2015) for i, t in enumerate(titles)]
    others = [("t", f"h{i}", titles[0] + "." * i, None, "Ann Lobanfel" if i % 2 else None, 2015) for i in range(20)]
    others += [("t", f"o{i}", t, None, "Ann Lobanfel", 2015) for i, t in enumerate(titles) if i]
    got = {(r.paper_id, r.other_id) for r in entities.match(spark.createDataFrame(papers, PAPER), spark.createDataFrame(others, OTHER)).collect()}
    assert len({o for p, o in got if p == "p0" and o[0] == "h"}) == 20 and len({o for _, o in got if o[0] == "o"}) == 29


def test_shortened_abstracts_match_by_title(spark):
    rng = random.Random(8)
    titles = titled(rng, 60)
    abstracts = [[rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(150)] for _ in titles]
    papers = [(f"p{i}", t, " ".join(a), "Ann Lobanfel", 2015) for i, (t, a) in enumerate(zip(titles, abstracts))]
    others = [("t", f"o{i}", t[1] + "q" + t[1:], " ".join(a[:14]), "Ann Lobanfel", 2015) for i, (t, a) in enumerate(zip(titles, abstracts))]
    got = {(r.paper_id, r.other_id) for r in entities.match(spark.createDataFrame(papers, PAPER), spark.createDataFrame(others, OTHER)).collect()}
    assert got == {(f"p{i}", f"o{i}") for i in range(60)}


def test_instruction_lines_are_counted_over_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 5)
    rng = random.Random(12)
    line = " ".join(rng.choices(VOCAB, k=24))
    items = [(i, (line + " " if i % 2 else "") + " ".join(rng.choices(VOCAB, k=40))) for i in range(20)]
    docs = [(0, line + " and more"), (1, "so " + items[3][1][len(line) :]), (2, items[4][1])]
    found = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert {(r.doc_id, i) for r in found.collect() for i in r.item_ids} == {(1, 3), (2, 4)}


def test_title_keys_agree_where_half_of_the_words_do():
    rng = random.Random(13)
    known = entities.Frequent((np.zeros(0, np.int64), np.zeros(0, np.int32)), [])
    shared = 0
    for _ in range(200):
        words = rng.sample(range(1, 10**6), 10)
        a, b = words[:8], words[:6] + words[8:]  # six of ten words in common
        x, y = (set(entities.keys_of(w, [], [], None, known).tolist()) for w in (a, b))
        shared += bool(x & y)
    assert shared >= 196
    long = entities.keys_of(list(range(1, 5000)), [], list(range(900)), None, known)
    assert len(long) <= entities.TITLE_ORDERS + entities.NAME_BANDS + 2


def test_confidence_is_calibrated():
    rng = np.random.default_rng(17)
    n = 60_000
    match = rng.random(n) < 0.15
    chars = np.clip(np.where(match, rng.normal(0.75, 0.2, n), rng.normal(0.45, 0.2, n)), 0, 1)
    people = np.clip(np.where(match, rng.normal(0.7, 0.3, n), rng.normal(0.2, 0.3, n)), 0, 1)
    unknown = (rng.random(n) < 0.5).astype(float)
    people *= 1 - unknown
    s = np.where(match, rng.uniform(0.3, 1, n), rng.uniform(0, 0.05, n))
    zero, one = np.zeros(n), np.ones(n)
    rows = lambda no, s: np.stack([s * (1 - no), no, chars, chars, chars, people, unknown, zero, zero, chars * no, chars * no, people * no, zero, zero, one], axis=1)
    half = n // 2
    model = entities.Matcher.train(rows(zero, s)[:half], rows(one, s)[:half], np.zeros(0, np.int64), np.zeros(0, np.int64))
    c, y = model.confidence(rows(one, s)[half:]), match[half:]
    gap = 0.0
    for k in range(10):
        at = (c >= k / 10) & (c < (k + 1) / 10 + (k == 9))
        if at.sum() >= 200:
            gap = max(gap, abs(c[at].mean() - y[at].mean()) * at.sum() / len(y))
            assert abs(c[at].mean() - y[at].mean()) < 0.1
    assert gap < 0.05


def test_words_that_tell_papers_apart_are_learned():
    full = np.zeros((60, len(entities.FEATURES)))
    full[:, 2] = 0.9
    full[:30, 0] = 0.9  # the first half agrees
    bare = full.copy()
    bare[:, entities.NO] = 1
    pair = np.arange(60)
    word = np.where(pair < 30, 7, 9)  # "abstract" against "reply"
    model = entities.Matcher.train(full, bare, pair, word)
    assert model.other(np.array([0, 1, 2]), np.array([7, 9, 5]), 4).tolist()[0] == 0 and model.other(np.array([1]), np.array([9]), 2)[1] > 0.5


def alike_titles(rng, n):
    """Papers whose titles are five words of thirty, so that most share three with hundreds; a record of each, half without an abstract."""
    titles = [" ".join(rng.sample(VOCAB[:30], 5)) for _ in range(n)]
    abstracts = [[rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(60)] for _ in titles]
    people = [" and ".join(f"{rng.choice(VOCAB)}{rng.choice(VOCAB)} {rng.choice(VOCAB)}{rng.choice(VOCAB)}".title() for _ in range(2)) for _ in titles]
    papers = [(f"p{i}", t, " ".join(a), q, 2015) for i, (t, a, q) in enumerate(zip(titles, abstracts, people))]
    others = [("t", f"o{i}", t[:4] + t[5:], " ".join(noisy(rng, a, 0.05)) if i % 2 else None, q, 2015) for i, (t, a, q) in enumerate(zip(titles, abstracts, people))]
    return papers, others


def test_pairs_of_like_titles_do_not_fill_the_disk(spark, monkeypatch):
    papers, others = alike_titles(random.Random(31), 800)
    staged, plain = [], entities.stage

    def counted(*args, **kwargs):
        table = plain(*args, **kwargs)
        staged.append(table.count())
        return table

    monkeypatch.setattr(entities, "stage", counted)
    got = {(r.paper_id, r.other_id) for r in entities.match(spark.createDataFrame(papers, PAPER), spark.createDataFrame(others, OTHER)).collect()}
    assert len(got & {(f"p{i}", f"o{i}") for i in range(800)}) >= 792
    assert max(staged) <= 10 * 1600  # before, a row for each key and one for each pair of three common words


def test_parts_slices_and_passes_give_the_same_pairs(spark, monkeypatch):
    papers, others = (spark.createDataFrame(x, c) for x, c in zip(alike_titles(random.Random(32), 150), (PAPER, OTHER)))
    rows = entities.records(papers.withColumn("source_name", F.lit("a")).unionByName(others.drop("other_table").withColumn("source_name", F.lit("b"))).withColumn("rid", F.xxhash64("id")))
    known = entities.Frequent((np.zeros(0, np.int64), np.zeros(0, np.int32)), [])
    keyed = entities.stage(entities.blocks(rows, known))
    pairs = lambda *x: [tuple(r) for r in entities.candidates_of(keyed, *x).collect()]
    whole = pairs(0, entities.PARTS, 1)
    assert len(whole) == len(set(whole)) >= 150
    apart = [pairs(a, b, 3) for a, b in ((0, 5), (5, 100), (100, entities.PARTS))]
    assert sorted(whole) == sorted(sum(apart, [])) and all(apart[1:])
    a, b = rows.filter("source_name = 'a'"), rows.filter("source_name = 'b'")
    table = entities.stage(entities.candidates_of(keyed, 0, entities.PARTS, 1))
    best = [sorted(tuple(r) for p in entities.best_of(table, a, b, known, entities.Matcher(), n) for r in p.collect()) for n in (1, 4)]
    assert best[0] and best[0] == best[1]
    want = {(r.paper_id, r.other_id, round(r.confidence, 9)) for r in entities.match(papers, others).collect()}
    for name in ("SLICE_BYTES", "RECORD_BYTES", "PAIRS"):
        monkeypatch.setattr(entities, name, 1)
    monkeypatch.setattr(entities, "PASS", 100)
    monkeypatch.setattr(entities, "KEY_BYTES", 0.01)
    got = {(r.paper_id, r.other_id) for r in entities.match(papers, others).collect()}
    assert len(got & {x[:2] for x in want}) >= 0.97 * len(want)


def test_sketches_never_drop_a_like_title(spark):
    rng = np.random.default_rng(5)
    known = entities.Frequent((np.zeros(0, np.int64), np.zeros(0, np.int32)), [])
    none = (np.zeros(0, np.int64), np.zeros(400, np.int64))
    left, right = [], []
    for _ in range(400):
        x = rng.integers(0, 1 << 31, rng.integers(1, 120))
        left.append(x)
        k = int(np.ceil(0.65 * len(x)))  # a share of 0.65 is kept, the rest replaced and added to
        right.append(np.concatenate([x[:k], rng.integers(0, 1 << 31, len(x) - k + rng.integers(0, 40))]))
    columns = [entities.sketches((np.concatenate(s), np.array([len(x) for x in s])), entities.Abstracts(none, known), none) for s in (left, right)]
    rows = [[int(c[i]) for side in columns for c in side] for i in range(400)]
    df = spark.createDataFrame(rows, ", ".join(f"{p}_{c} long" for p in "ab" for c in entities.SKETCH))
    assert df.filter(entities.COMPARED).count() == 400
    turned = [[int(c[i]) for c in columns[0]] + [int(c[(i + 7) % 400]) for c in columns[1]] for i in range(400)]
    assert spark.createDataFrame(turned, df.schema).filter(entities.COMPARED).count() < 40


def test_staging_frees_its_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in n}
    before = shuffled()
    table = stage.stage(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).count(), release=True)
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and table.count() == 700
    assert spark.conf.get(stage.CLEANUP) == "false"
    stage.drop(table)
    assert not any(table.inputFiles()[0].rpartition("/")[0].endswith(m.rpartition("/")[2]) for m in stage._made)
