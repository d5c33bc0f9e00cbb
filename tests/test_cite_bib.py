from pyspark.sql import functions as F
from scholarmill.functions import bib, cite, titles


def values(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f(F.col("t")).alias("o")).orderBy("i").collect()
    return [r.o for r in rows]


def test_numbered_citations():
    text, tokens = cite.number_citations("A~\\citep{x} b \\cite{y, z} c \\cite{a,}")
    assert text == "A<|cite_1|> b<|multi_cite_2_1|><|multi_cite_2_2|> c<|multi_cite_3_1|><|multi_cite_3_2|>"
    assert [t["key"] for t in tokens] == ["x", "y", "z", "a", ""]
    text, tokens = cite.number_citations("A\\citep{x} b\\cite{y}", by_command=True)
    assert text == "A<|cite_2|> b<|cite_1|>"
    assert cite.number_citations("\\cite[p]{x} \\cite*{y}") == ("\\cite[p]{x} \\cite*{y}", [])
    assert cite.number_citations(None) == (None, [])


def test_citation_columns(spark):
    assert values(spark, ["\\cite{a, b}\\citet*[see][2]{c}\\footcite{d}", "", None], cite.cited_keys) == [["a", "b", "c", "d"], [], None]
    assert values(spark, ["x~\\citep[a]{b} y \\cites{c}"], cite.remove_citations) == ["x y"]
    assert values(spark, ["a <|cite_1|> b<|multi_cite_2_1|>"], cite.split_with_citations) == [["a", "<|cite_1|>", "b", "<|multi_cite_2_1|>"]]
    got = values(spark, ["\\cite{a} \\cite{b}.\\textbf{x} \\cite{c}", None], cite.merge_citations)
    assert got == ["\\cite{a, b}.\\textbf{x} \\cite{c}", None]


def test_shrink_and_cut(spark):
    text = "One. <|cite_start|>a. b. c.<|cite_end|> two! three? four."
    assert values(spark, [text], lambda c: cite.shrink_citations(c).text) == ["One. $0$ two! three? four."]
    back = lambda c: cite.expand_citations(cite.shrink_citations(c).text, cite.shrink_citations(c).spans)
    assert values(spark, [text, ""], back) == [text, ""]
    cut = values(spark, [text, "One. two"], lambda c: cite.cut_after_sentences(c))
    assert (cut[0].enough, cut[0].text) == (True, "One. <|cite_start|>a. b. c.<|cite_end|> two! three?")
    assert (cut[1].enough, cut[1].text) == (False, "One. two")
    assert values(spark, ["a. b.\nc", "none"], cite.back_to_sentence) == ["a. b.", "none"]


def test_replace_citations(spark):
    span = "<|cite_start|>x<|cite_end|>"
    df = spark.createDataFrame([(f"a{span}b{span}c{span}d{span}", ["k: 1:", "k: 1:", "m,2"])], "t string, k array<string>")
    assert df.select(cite.replace_citations(F.col("t"), F.col("k")).alias("o")).first().o == "a\\cite{k:1}bc\\cite{m2}d"


def test_items(spark):
    bbl = "\\begin{thebibliography}{9}\n\\bibitem{a} One\n  two\n\n\\bibitem[L{x}]{b} Three\n\\end{thebibliography} after"
    assert values(spark, [bbl, None], bib.bbl_items) == [["\\bibitem{a} One\ntwo", "\\bibitem[L{x}]{b} Three"], None]
    text = "% no\n@article{a,\n title={X {Y}},\n}\n@misc{b, title={Z}}\nstray\n@book{c,\n year={1}"
    assert bib.split_bib(text) == ["@article{a,\ntitle={X {Y}},\n}", "@misc{b, title={Z}}", "@book{c,\nyear={1}"]
    assert bib.split_bib(None) == []
    assert values(spark, [bbl.split("\n")[1], "\\bibitem[A {B} C]{ k }", "@x{k2, title={T}}", "junk"], bib.bibitem_key) == ["a", "k", "k2", None]


def test_entries(spark):
    e = "@InProceedings{key1,\n booktitle = {Book},\n title = {{A} Title},\n year={2001}, YEAR={2002}}"
    assert values(spark, [e, "x"], bib.entry_key) == ["key1", None]
    assert values(spark, ["@a{k, booktitle={B}, title={T}}", '@a{k, title = "Q"}'], bib.entry_title) == ["T", "Q"]
    assert values(spark, ["@a{k, booktitle={B}, title={T}}"], lambda c: bib.entry_title(c, whole_word=False)) == ["B"]
    got = values(spark, [e], bib.entry_fields)[0]
    assert (got.type, got.key, got.fields["year"], got.fields["title"]) == ("inproceedings", "key1", "2002", "{A} Title")
    assert bib.item_title("\\bibitem{a} A. Author.\n\\newblock The Title.\n\\newblock Journal, 2001.") == "The Title"
    assert bib.item_title("\\bibitem{a} A. Author, ``Quoted title,'' Proc.") == "Quoted title"
    assert bib.item_title(None) is None


def test_bibtex(spark):
    cols = "id string, title string, authors string, last string, created string, ref string, doi string, no string, cat string"
    rows = [("1", "A Title", "Ann B\\'e", "B", "Mon, 2 Apr 2007 19:18:42 GMT", None, "d", None, "cs.CL"), ("2", "T", "X Y, Z W", None, None, "J: 1, 1999", None, None, None), ("3", None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, cols).select(bib.bibtex(*[F.col(c.split()[0]) for c in cols.split(", ")]).alias("b")).select("b.*").collect()
    assert df[0].citation_key == "b2007a" and df[0].bibtex.endswith("primaryClass={cs.CL}\n}") and "journal={arXiv preprint arXiv:1}" in df[0].bibtex
    assert df[1].citation_key == "y1999t" and "journal={J: 1, 1999}" in df[1].bibtex
    assert df[2].citation_key == "3" and "Unknown Title" in df[2].bibtex


def test_titles(spark):
    assert values(spark, ["  A--B:\tC9 ", "", None], titles.normalize_title) == ["a b c9", "", None]
    assert values(spark, ["\\emph{A} \\& B\u00a0C``d''*"], titles.join_title) == ['a & b c"d"']
    assert values(spark, ["{A}.\n b  c"], titles.display_title) == ["A b c"]


def test_numbers_by_command(spark):
    df = spark.createDataFrame([("a \\citep{x} b~\\cite{y,z} c \\citep{w}",), (None,)], "t string")
    row, none = (r.c for r in df.select(cite.extract_citations_by_command(F.col("t")).alias("c")).collect())
    assert row.text == "a<|cite_2|> b<|multi_cite_1_1|><|multi_cite_1_2|> c<|cite_3|>"
    assert [(k.token, k.key) for k in row.tokens] == [("<|multi_cite_1_1|>", "y"), ("<|multi_cite_1_2|>", "z"), ("<|cite_2|>", "x"), ("<|cite_3|>", "w")]
    assert none.text is None
