import pytest
from scholarmill.llm import langid, markup

HELD_OUT = {
    "en": "The committee has decided that the report should be published next week. Nobody knows whether these changes will help.",
    "de": "Der Ausschuss hat beschlossen, dass der Bericht nächste Woche veröffentlicht werden soll. Niemand weiß, ob diese Änderungen helfen.",
    "fr": "Le comité a décidé que le rapport sera publié la semaine prochaine. Personne ne sait si ces changements seront utiles.",
    "es": "El comité ha decidido que el informe se publicará la próxima semana. Nadie sabe si estos cambios van a ayudar mucho.",
    "it": "Il comitato ha deciso che la relazione sarà pubblicata la prossima settimana. Nessuno sa se questi cambiamenti saranno utili.",
    "pt": "O comitê decidiu que o relatório será publicado na próxima semana. Ninguém sabe se essas mudanças vão ajudar muito.",
    "nl": "De commissie heeft besloten dat het rapport volgende week wordt gepubliceerd. Niemand weet of deze veranderingen zullen helpen.",
    "ru": "Комитет решил, что доклад будет опубликован на следующей неделе. Никто не знает, помогут ли эти изменения.",
    "zh": "委员会决定下周发表这份报告。没有人知道这些改变是否会有帮助。",
}


@pytest.fixture(scope="module")
def profiles():
    return langid.seeded()


@pytest.mark.parametrize("lang", HELD_OUT)
def test_held_out_language(profiles, lang):
    ((found, n, conf, start, end),) = langid.segments([HELD_OUT[lang]], profiles)[0]
    assert found == lang and n == 2 and conf > 0.5 and (start, end) == (0, len(HELD_OUT[lang]))


def test_segments(profiles):
    mixed = HELD_OUT["en"] + "\n\n" + HELD_OUT["de"]
    assert [s[0] for s in langid.segments([mixed], profiles)[0]] == ["en", "de"]
    quoted = HELD_OUT["en"] + " See “Par ailleurs, le réseau examine la structure” for a translation. " + HELD_OUT["en"]
    assert [s[0] for s in langid.main_languages(langid.segments([quoted], profiles)[0])] == ["en"]
    assert langid.segments(["", None, "12 34", "$x_{3}^2 + y_{4}$", "..."], profiles) == [[]] * 5
    assert len(langid.segments([HELD_OUT["fr"] * 3000], profiles)[0]) == 1


def test_segments_tell_their_place(profiles):
    text = "İ. “Guillemets” " + HELD_OUT["en"] + "\n\n" + HELD_OUT["de"] + "  $x$"
    a, b = langid.segments([text], profiles)[0]
    assert text[a[3] : a[4]].strip().endswith(HELD_OUT["en"]) and text[b[3] : b[4]] == HELD_OUT["de"]


def test_distances_against_plain_python(profiles):
    texts = sum((langid.sentences(t) for t in HELD_OUT.values()), []) + ["xqzj qqq", "a", "the the the of of"]
    got = profiles.distances(texts)
    codes = {int(c): n for side in (0, 1) for c, n in zip(profiles.lookup.code[side], profiles.lookup.number[side]) if n >= 0}
    for t, row in zip(texts, got):
        n: dict[int, int] = {}
        for c in langid._codes([t])[1].tolist():
            if c in codes:
                n[codes[c]] = n.get(codes[c], 0) + 1
        order = sorted(n, key=lambda g: (-n[g], g))
        for k in range(len(profiles.languages)):
            want = sum(min(abs(int(profiles.ranks[g, k]) - i), profiles.size) for i, g in enumerate(order))
            assert abs(row[k] - want / max(1, len(order)) / profiles.size) < 1e-9


def test_labels():
    for raw, want in {"EN": "en", "en-GB": "en", "English": "en", "nld": "nl", "zh-Hans": "zh", "por": "pt", " de ": "de", "unk": None, "und": None, "": None, None: None, "sv": None}.items():
        assert langid.label(raw) == want


def test_detect(spark, profiles):
    rows = [(1, HELD_OUT["de"], None), (2, HELD_OUT["de"], "deu"), (3, HELD_OUT["de"], "en"), (4, None, "en"), (5, "", None), (6, "123", None), (7, HELD_OUT["en"] + "\n\n" + HELD_OUT["ru"], "en"), (8, HELD_OUT["zh"], "zh")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, label string")
    found = langid.detect(df, "doc_id", "text", "lang", profiles)
    assert found.count() == 8
    assert {tuple(r) for r in langid.mislabelled(found, "doc_id").collect()} == {(1, "de"), (3, "de"), (7, "en"), (7, "ru")}
    fitted = langid.fitted(df, "text")
    assert {tuple(r) for r in langid.mislabelled(langid.detect(df, "doc_id", "text", "lang", fitted), "doc_id").collect()} == {(1, "de"), (3, "de"), (7, "en"), (7, "ru")}
    assert langid.detect(df.limit(0), "doc_id", "text", "lang", langid.fitted(df.limit(0), "text")).count() == 0


PLAIN = [
    "Files live in D:\\runs\\53 on the bench.", "It holds that a <= b and b >= c <|cite_27|>.", "Runs cost $13 and $57 per day.", "We rank first at #7 of 79.", "The grid has 4 * 7 * 8 cells.",
    "The flag max_seq_len was set to 9.", "Costs follow a ~29 day cycle.", "Scores rose by 82% (n = 698).", "See [42] and [48, 28] for R&D reports.", "The tuple {7, 7} is unordered.", "We keep pairs with p < 0.05 and q > 11.",
    "Plain Heading\n\nText <|multi_cite_39_1|><|multi_cite_39_2|>.", "@article{a2001,\n  title = {A {B} Title},\n  year = {2001}\n}", "[1] Name, A. A Title. Journal, 3(6):178-313, 2005.",
]
MARKED = [
    "an <b>attempt</b>", "a&nbsp;b", "x<br>y", "\\section{A}", "costs~\\cite{a}", "the $x_{3}$ value", "{\\it patch}", "\\bibitem{k} T", "Ka{\\\"u}b", "## Head\ntext", "the **cost** of", "a __b__ c", "- item\n- item",
    "[^5] note", "[a](https://b.c)", "`code` here", "```\nx\n```", "== Head ==", "''it''", "[[link|text]]", "a{{cn|date=2014}} b", "<ref>n</ref>", "% TODO query\n", "``quoted''", "@a{k,\n title = {\\emph{T}},\n}",
]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_has_no_markup(text):
    assert markup.tokens(text) == [] and markup.clean(text) == text


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert markup.tokens(text)


def test_cleaning():
    cases = {
        "\\section{Head}\nA \\emph{b}~\\cite{k}.\n\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}": "# Head\n\nA b [k].\n\n- one\n- two",
        "<h2>Head</h2><p>x &amp; y</p><ul><li>a</li><li>b</li></ul>": "## Head\nx & y\n\n- a\n- b",
        "== Head ==\n* [[x|y]] '''b'''{{cn}}": "# Head\n- y b",
        "\\begin{verbatim}\nfor x in <y>:\n\\end{verbatim}": "```\nfor x in <y>:\n```",
        "<math>x_1 < 2</math> and \\(y\\)": "$x_1 < 2$ and $y$",
        "note\\footnote{extra} `a_b_c`": "note (extra) `a_b_c`",
        "Files live in D:\\runs\\53, **bold**": "Files live in D:\\runs\\53, bold",
    }
    for raw, want in cases.items():
        assert markup.clean(raw) == want
    assert markup.clean(None) is None and markup.clean("") == ""
    assert len(markup.clean("<b>" + "word " * 50_000 + "</b>")) > 200_000


def test_queries_over_values(spark):
    rows = [(1, "<p>a</p>", None, ""), (1, "<p>a</p>", None, ""), (2, "<p>b</p><p>c</p>", "plain", "\\bibitem{x} <i>t</i>"), (3, None, None, None), (4, "<p>d</p> ==", "<div>x</div>", None)]
    df = spark.createDataFrame(rows, "part_id long, intro string, related_work string, bib string").withColumn("field", markup.F.lit("clash"))
    vals = markup.values(df, "part_id", ("intro", "related_work", "bib"))
    pages = markup.pages(vals, "part_id")
    assert {tuple(r) for r in markup.with_markup(pages, "part_id").collect()} == {(1, "intro"), (2, "intro"), (2, "bib"), (4, "intro"), (4, "related_work")}
    found = {tuple(r.tokens): r.valid for r in markup.classes(pages).collect()}
    assert found[("</p>", "<p>")] and not found[("</div>", "<div>")]
    assert {(r.part_id, r.field): r.clean_text for r in markup.cleaned(vals, "part_id").collect()}[2, "intro"] == "b\n\nc"
    empty = markup.values(df.limit(0), "part_id", ("intro", "related_work", "bib"))
    assert empty.count() == 0 and markup.classes(markup.pages(empty, "part_id")).count() == 0


def test_unlisted_tags_are_found_by_their_classes(spark):
    text = ["<aside2 n=1>a</aside2><aside2>b</aside2>", "x <aside2>c</aside2>", "<aside2>d</aside2> **e**", "[quote=x]f[/quote] <once>", "[quote]g[/quote]", "[quote]h[/quote]", "a <lone> b", "c <lone> d", "e <lone> f", "plain [x]", "```\n<aside2>\n```"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(text)], "part_id long, intro string, bib string")
    vals = markup.values(df, "part_id", ("intro", "bib"))
    found = {r.part_id for r in markup.with_markup(markup.pages(vals, "part_id"), "part_id").collect()}
    assert found == {0, 1, 2, 3, 4, 5, 10}
    got = {r.part_id: r.clean_text for r in markup.cleaned(vals, "part_id").collect()}
    assert [got[i] for i in range(len(text))] == ["a\nb", "x c", "d e", "f <once>", "g", "h", *text[6:]]


def test_classes_nest_into_templates(spark, monkeypatch):
    text = ["<ul><li>a</li></ul><p>b</p>", "<p>x</p><ul><li>c</li></ul>", "<ul><li>d</li></ul>", "<i>1</i><u>2</u>", "<u>1</u><i>2</i>", "<i><u>1</u></i>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "part_id long, intro string")
    vals = markup.values(df, "part_id", ("intro",))
    pages = markup.pages(vals, "part_id")
    found = {tuple(r.tokens): r for r in markup.templates(pages).collect()}
    whole = found["</li>", "</ul>", "<li>", "<ul>"]
    assert whole.valid and whole.n_pages == 3 and whole.parent_id is None
    assert not found["</i>", "</u>", "<i>", "<u>"].valid  # their order differs
    assert found[("any tag",)].valid and found[("any tag",)].n_pages == 6
    text = ["<div>" + t * k + "</div>" for k, t in enumerate(["<b>x</b>"] * 4, 1)] + ["<div></div>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "part_id long, intro string")
    found = {tuple(r.tokens): r for r in markup.templates(markup.pages(markup.values(df, "part_id", ("intro",)), "part_id")).collect()}
    assert found["</b>", "<b>"].valid and found["</b>", "<b>"].parent_id == found["</div>", "<div>"].class_id
    # what is found and cleaned comes from the classes
    none = markup.classes(pages).limit(0)
    monkeypatch.setattr(markup, "classes", lambda paged: none)
    assert markup.with_markup(pages, "part_id").count() == 0
    assert {r.clean_text for r in markup.cleaned(vals, "part_id").collect()} == {r.intro for r in vals.select(markup.F.col("value").alias("intro")).collect()}


def test_tokens_outside_of_the_template_stay():
    assert markup.clean("**a** and \\emph{b}", {("latex", "\\emph")}) == "**a** and b"
    assert markup.clean("**a** and \\emph{b}", {("markdown", "any strong")}) == "a and \\emph{b}"
    assert markup.clean("**a**", set()) == "**a**"
    assert markup.tokens("the $" + "x_1 + " * 200 + "y$ sum") and markup.tokens("``" + "long " * 200 + "quote''")


@pytest.mark.parametrize("opening", ["<!-- ", "\\[ ", "<pre> ", "<math> ", "[[", "\\begin{verbatim} ", "``a ", "`"])
def test_openings_that_open_nothing_stay_linear(opening):
    import time

    start = time.time()
    text = opening * 20_000
    markup.all_tokens(text), markup.clean(text), langid.counted(text)
    assert time.time() - start < 20
    assert markup.clean("<!-- a --> b <!-- c") == "b <!-- c" and markup.clean("<pre>x</pre> <pre>y") == "```\nx\n```\n y"
