"""Queries over whole tables and texts against plain Python."""

import hashlib
import re

import pytest

TEXTS = ["a % b\nc " * 40 + "~\\cite{zz, yy} 50\\% {of} it % end", "short", "", None, "A $0$ b <|cite_start|>P. Q. R $1$. S<|cite_end|> c. D! <|cite_start|>T. U<|cite_end|> e? F. G", "x" * 119 + "\\%" + "y" * 200 + "\n% gone\n" + "z" * 3000 + " \\citep{last}"]


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, t, "note") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


def framed(i, t):
    from scholarmill.plans.text_queries import _HEAD as h
    from scholarmill.plans.text_queries import _TAILS

    k = len(t) // 2
    return "".join([h[0], "note", h[1], str(i), h[2], "note", h[3], t[:k], h[4], str(i % 7), h[5], str(i % 11), h[6], t[k:], h[7], str(i % 5), h[8], str(i % 3), h[9], _TAILS[i % 4]])


def run(spark, name, d):
    import __spark_entry__ as entry

    return entry.queries()[name](spark, d).collect()


def test_latex_operators_read_whole_texts(spark, data):
    want = {i: framed(i, t) for i, t in enumerate(TEXTS) if t is not None}
    got = {r.doc_id: (r.h, r.h_all) for r in run(spark, "strip_comments", data)}
    assert got == {i: (md5(re.sub(r"(^|[^\\])%[^\n]*", r"\1", t)), md5(re.sub(r"%[^\n]*", "", t))) for i, t in want.items()}
    body = {r.doc_id: r.body for r in run(spark, "document_parts", data)}
    assert body == {i: md5(t[t.index("\\begin{document}") :]) for i, t in want.items()}
    main = {r.doc_id: (r.main, r.related) for r in run(spark, "extract_sections", data)}
    cut = lambda t: t[t.index("\\section{Related Work}") + 22 : t.index("\\section{Method}")].strip()
    ends = ["\\section*{Ack", "\\section*{Ack", "\\appendix", "\\begin{thebib"]
    assert main == {i: (md5(t[: t.index(ends[i % 4])]), md5(cut(t))) for i, t in want.items()}
    keys = {}
    for r in sorted(run(spark, "citations_explode", data), key=lambda r: (r.doc_id, r.pos)):
        keys.setdefault(r.doc_id, []).append(r.key)
    cited = lambda t: [k.strip() for g in re.findall(r"\\(?:citep|citet|cite)\*?(?:\[[^\]]*\])*\{([^}]+)\}", t) for k in g.split(",")]
    assert keys == {i: cited(t) for i, t in want.items()} and "last" in keys[5] and "zz" in keys[0]


def test_sentences_are_cut_outside_of_spans(spark, data):
    heads = {r.doc_id: (r.enough, r.head) for r in run(spark, "three_sentences", data)}
    assert set(heads) == {0, 1, 2, 4, 5}
    assert heads[4] == (True, md5(TEXTS[4].removesuffix(" F. G"))) and heads[1] == (False, md5("short"))


def norm(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).strip(" ")


def test_every_title_takes_part(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("titles"))
    titles = ["Naïve Bayes", "naïve  bayes!", "Plain Title", "Größe Zero", "日本", None, "\\emph{Deep} ``Nets''", "中国"]
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    write("corpus_data", [(f"c{i}", f"p{i}", t, "a", "ss") for i, t in enumerate(titles)], "corpus_id string, paper_id string, title string, abstract string, source string")
    write("title_lookup", [(i, t, f"l{i}") for i, t in enumerate(titles)], "lookup_id long, title string, paperid string")
    write("citations", [("x", i, t, f"k{i}", "given" if i == 3 else None) for i, t in enumerate([*titles, "Öther"])], "arxiv_id string, pos int, title string, citation_key string, citation_corpus_id string")
    write("bibtex", [("b8", "k8")], "id string, citation_key string")
    key = lambda t: norm(t) or t
    have = [(f"c{i}", key(t)) for i, t in enumerate(titles) if t]
    first, last = {n: min(c for c, m in have if m == n) for _, n in have}, {n: max(c for c, m in have if m == n) for _, n in have}
    assert {r.norm: r.corpus_id for r in run(spark, "normalize_title_dedup_first", d)} == first
    assert {r.norm: r.corpus_id for r in run(spark, "normalize_title_dedup_last", d)} == last
    assert {r.corpus_id: r.norm for r in run(spark, "normalize_titles", d)} == {f"c{i}": norm(t) for i, t in enumerate(titles) if t}
    assert {r.lookup_id: r.corpus_id for r in run(spark, "exact_match_lookup", d)} == {i: first[key(t)] for i, t in enumerate(titles) if t}
    got = {r.pos: (r.value, r.resolved_by) for r in run(spark, "resolve_cascade", d)}
    assert got == {i: ("given", "given") if i == 3 else (first[key(t)], "exact") for i, t in enumerate(titles) if t} | {8: ("b8", "bibtex")}
    keys = {r.pos: r.key for r in run(spark, "citation_titles", d)}
    assert keys == {0: "naïve bayes", 1: "naïve bayes!", 2: "plain title", 3: "größe zero", 4: "日本", 6: 'deep "nets"', 7: "中国", 8: "öther"}
