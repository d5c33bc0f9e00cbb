"""Queries of LaTeX, citation and bibliography functions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarmill.functions import bib, cite, latex, titles
from scholarmill.plans.registry import query
from scholarmill.sources.tables import table

# A document as LaTeX, the same concatenation in both engines: the whole text in two halves, ended in one of four ways.
_HEAD = ["\\documentclass{article}\n\\usepackage{x}\n\\title{", " {No.} ", "}\n\\begin{document}\n\\begin{abstract}\nAbout ", " % a remark\n\n\\end{abstract}\n\\section{Introduction}\n", "~\\cite{k", ",k", "} % note\nMore \\% text.\n\\section{Related Work}\n", " \\citep{k", "} and \\citet[see][p. 3]{k", "}.\n\\begin{figure}\nf\n\\caption{c}\n\\end{figure}\n\\section{Method}\nM\n"]
_TAILS = [
    "\\section{Conclusion}\nDone.\n\\section*{Acknowledgements}\nThanks.\n\\end{document}\n",
    "\\section*{Acknowledgements}\nThanks.\n\\end{document}\n",
    "\\includegraphics[width=1]{x}\n\\appendix\nA\n\\end{document}\n",
    "\\section{Conclusions and future work}\nDone.\n\\begin{thebibliography}\n\\bibitem{a} A.\n\\end{thebibliography}\n\\end{document}\n",
]


def _lit(x: str) -> str:
    """A string in SQL."""
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_H = [_lit(h) for h in _HEAD]
_SQL_TEX = f"""WITH tex AS (SELECT doc_id, {_H[0]} || source || {_H[1]} || doc_id || {_H[2]} || source || {_H[3]} || substr(text, 1, length(text) // 2) || {_H[4]} || (doc_id % 7) || {_H[5]} || (doc_id % 11) || {_H[6]} || substr(text, length(text) // 2 + 1) || {_H[7]} || (doc_id % 5) || {_H[8]} || (doc_id % 3) || {_H[9]}
  || CASE doc_id % 4 WHEN 0 THEN {_lit(_TAILS[0])} WHEN 1 THEN {_lit(_TAILS[1])} WHEN 2 THEN {_lit(_TAILS[2])} ELSE {_lit(_TAILS[3])} END AS t FROM documents WHERE text IS NOT NULL)"""


def latex_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, t): each document's whole text, in two halves, in a LaTeX frame."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    c = lambda m: (F.col("doc_id") % m).cast("string")
    h = [F.lit(x) for x in _HEAD]
    tail = F.element_at(F.array(*[F.lit(x) for x in _TAILS]), (F.col("doc_id") % 4 + 1).cast("int"))
    t = F.concat(h[0], "source", h[1], F.col("doc_id").cast("string"), h[2], "source", h[3], first, h[4], c(7), h[5], c(11), h[6], second, h[7], c(5), h[8], c(3), h[9], tail)
    return table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", t.alias("t"))


# The written rules in SQL: positions of literals and of patterns, tried in list order.
_WS = "[ \\t\\r\\f\\v\\n]"
_trim = lambda x, space=_WS: f"regexp_replace({x}, '^{space}+|{space}+$', '', 'g')"
_least = lambda t, literals: "list_min(list_filter([" + ", ".join(f"strpos({t}, {_lit(x)})" for x in literals) + "], lambda x: x > 0))"
_before = lambda t, patterns: "coalesce(" + ", ".join(f"CASE WHEN regexp_matches({t}, '(?i){p}') THEN string_split_regex({t}, '(?i){p}')[1] END" for p in patterns) + ")"
_T = "t"


@query(_SQL_TEX + " SELECT doc_id, md5(regexp_replace(t, '(^|[^\\\\])%[^\\n]*', '\\1', 'g')) AS h, md5(regexp_replace(t, '%[^\\n]*', '', 'g')) AS h_all FROM tex")
def strip_comments(spark: SparkSession, d: str) -> DataFrame:
    """ST-1, ST-2: comments, with and without regard to escapes."""
    return latex_documents(spark, d).select("doc_id", F.md5(latex.strip_comments(F.col(_T))).alias("h"), F.md5(latex.strip_all_comments(F.col(_T))).alias("h_all"))


@query(_SQL_TEX + r""" SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '(^|[^\\])%[^\n]*', '\1', 'g'), '(?s)\\begin\{comment\}.*?\\end\{comment\}', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS h FROM tex""")
def clean_source(spark: SparkSession, d: str) -> DataFrame:
    """ST-1: comments, disabled parts and blank lines."""
    return latex_documents(spark, d).select("doc_id", F.md5(latex.clean_source(F.col(_T))).alias("h"))


@query(_SQL_TEX + r""", x AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?s)\\begin\{figure\}.*?\\end\{figure\}', '', 'g'), '\\includegraphics(\[[^\]]*\])?\{[^}]*\}', '', 'g') AS a FROM tex) SELECT doc_id, md5(regexp_replace(regexp_replace(a, '\n[ \t\r\f\v\n]*\n', chr(10) || chr(10), 'g'), '^[ \t\r\f\v\n]+|[ \t\r\f\v\n]+$', '', 'g')) AS h FROM x""")
def remove_floats(spark: SparkSession, d: str) -> DataFrame:
    """ST-3: figures, tables and captions."""
    return latex_documents(spark, d).select("doc_id", F.md5(latex.remove_floats(F.col(_T))).alias("h"))


@query(_SQL_TEX + r""", x AS (SELECT doc_id, t, regexp_replace(regexp_extract(t, '(?s)\\title\{([^}]+)\}', 1), '[ \t\r\f\v\n]+', ' ', 'g') AS title, trim(regexp_replace(regexp_extract(t, '(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}', 1), '[ \t\r\f\v\n]+', ' ', 'g')) AS a FROM tex)
  SELECT doc_id, md5(substr(t, strpos(t, '\begin{document}'))) AS body, translate(trim(title), '{}.', '') AS title, md5(regexp_replace(a, '(^|[^\\])%[^\n]*', '\1', 'g')) AS abstract FROM x""")
def document_parts(spark: SparkSession, d: str) -> DataFrame:
    """ST-4, ST-11, ST-12, ST-15: body, title up to its first closing brace, and abstract."""
    return latex_documents(spark, d).select("doc_id", F.md5(latex.remove_preamble(F.col(_T))).alias("body"), latex.title(F.col(_T)).alias("title"), F.md5(latex.abstract(F.col(_T))).alias("abstract"))


_MARKS = [*latex.REFERENCES, *latex.THANKS, r"\\textbf\{acknowledgement\}", *latex.APPENDIX]
_CONCLUDED = [rf"\\section\*?\{{{p}" for p in latex.CONCLUSIONS]


@query(
    _SQL_TEX + f""", p AS (SELECT doc_id, t, {_least('t', latex.RELATED)} AS r FROM tex), q AS (SELECT *, substr(t, r) AS from_head, {" ".join(["CASE", *(f"WHEN starts_with(substr(t, r), {_lit(x)}) THEN {len(x)}" for x in latex.RELATED), "END"])} AS n FROM p),
  r AS (SELECT doc_id, t, substr(from_head, n + 1) AS rest FROM q), s AS (SELECT *, {_least('rest', latex.SECTION)} AS e FROM r),
  c AS (SELECT doc_id, t, rest, e, {_before('t', _CONCLUDED)} AS head FROM s), d AS (SELECT *, substr(t, length(head) + 1) AS tail FROM c),
  f AS (SELECT *, regexp_extract(tail, '(?i)^({"|".join(sorted(_CONCLUDED, key=len))})', 1) AS heading FROM d), g AS (SELECT *, substr(tail, length(heading) + 1) AS after FROM f),
  h AS (SELECT *, CASE WHEN contains(after, '\\section') THEN substr(after, 1, strpos(after, '\\section') - 1) ELSE coalesce({_before('after', _MARKS)}, after) END AS ending, coalesce({_before('t', latex.REFERENCES)}, t) AS plain FROM g)
  SELECT doc_id, md5(coalesce({_trim("CASE WHEN e IS NULL THEN rest ELSE substr(rest, 1, e - 1) END")}, '')) AS related,
    md5(CASE WHEN head IS NOT NULL THEN head || heading || ending ELSE coalesce({_before('t', latex.THANKS)}, {_before('plain', latex.APPENDIX)}, plain) END) AS main FROM h"""
)
def extract_sections(spark: SparkSession, d: str) -> DataFrame:
    """ST-5, ST-8: the related-work section and the main body."""
    return latex_documents(spark, d).select("doc_id", F.md5(latex.related_work(F.col(_T))).alias("related"), F.md5(latex.main_body(F.col(_T))).alias("main"))


# White space of Unicode, as a class of the regular expressions that SQL has.
_UWS = "[\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_headed = lambda names: rf"(?:\\(?:section|subsection|chapter)\*?\{{(?:{names})\}}|(?:2|II)\.{_WS}+(?:{names})|\\noindent{_WS}*\\textbf\{{(?:{names})\}})"
_SECTION_END = rf"(?:\n{_WS}*\\(?:section|chapter|paragraph)|\n{_WS}*(?:\d+\.|[IVX]+\.)|\\begin\{{|\\end\{{document\}}|\z)"
_BY_HEAD = lambda names: f"nullif(regexp_extract(t, '(?is){_headed(names)}{_WS}*(.*?){_WS}*{_SECTION_END}', 1), '')"
_BY_WORD = lambda words: f"list_filter(regexp_extract_all(replace(t, chr(10) || chr(10), chr(10) || chr(10) || chr(10) || chr(10)), '(?s)\\n\\n(.+?)\\n\\n', 1), lambda p: regexp_matches(lower(p), '{words}'))[1]"


@query(
    _SQL_TEX + f""", a AS (SELECT doc_id, t, nullif(regexp_extract(t, '(?is){latex.introduction_heading(_WS)}{_WS}*(.*?){_WS}*(?:\\n{_WS}*\\\\(?:section|chapter)|\\n{_WS}*(?:\\d+\\.|II\\.)|\\z)', 1), '') AS intro,
    coalesce({_BY_HEAD('Related Works?|Previous Work|Prior Research')}, {_BY_HEAD('Background|State of the Art|Literature Review')}) AS sec FROM tex),
  b AS (SELECT doc_id, t, intro, {_trim(f"coalesce(regexp_replace(sec, '\\\\subsection\\{{[^}}]+\\}}', chr(10) || chr(10), 'g'), {_BY_WORD('related work|previous work|prior research')}, {_BY_WORD('background|state of the art|literature review')})")} AS related FROM a),
  c AS (SELECT *, regexp_replace(regexp_replace(intro, '(^|[^\\\\])%[^\\n]*\\n', '\\1' || chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS x, strpos(t, intro) AS i, strpos(t, related) AS r FROM b)
  SELECT doc_id, md5({_trim(f"array_to_string(list_transform(string_split(x, chr(10)), lambda l: {_trim('l', _UWS)}), chr(10))", _UWS)}) AS intro, md5(related) AS related,
    md5(CASE WHEN intro IS NULL OR length(intro) < 100 THEN t WHEN related IS NULL OR length(related) < 100 THEN substr(t, i + length(intro))
      WHEN i > 0 AND r > i THEN (CASE WHEN r - i - length(intro) > 2000 THEN substr(t, i + length(intro), r - i - length(intro)) ELSE '' END) || substr(t, r + length(related)) ELSE '' END) AS other FROM c"""
)
def section_parts(spark: SparkSession, d: str) -> DataFrame:
    """ST-6, ST-7, ST-9, ST-16: introduction, related work by pattern, and the rest; compared to known sections in the tests too."""
    df = latex_documents(spark, d).select("doc_id", "t", latex.introduction(F.col(_T)).alias("intro"), latex.related_work_by_pattern(F.col(_T)).alias("related"))
    return df.select("doc_id", F.md5(latex.clean_section(F.col("intro"))).alias("intro"), F.md5("related").alias("related"), F.md5(latex.other_text(F.col(_T), F.col("intro"), F.col("related"))).alias("other"))


_FIRST_HEADS = "|".join(m.replace("NAME", "Introduction").replace(r"\s*", _WS + "*").replace(r"\s+", _WS + "+") for m in latex.INTRO_MARKS)


_FIRST = rf"regexp_extract(t, '(?is)(?:{_FIRST_HEADS})(.+?)\n(?:\\section|\\chapter|\d+\.|II\.|\\begin\{{)', 1)"


@query(_SQL_TEX + f" SELECT doc_id, md5(nullif({_trim(_FIRST)}, '')) AS intro FROM tex")
def first_generation_intro(spark: SparkSession, d: str) -> DataFrame:
    """ST-10: introductions by the first generation's rule."""
    return latex_documents(spark, d).select("doc_id", F.md5(latex.introduction_first_generation(F.col(_T))).alias("intro"))


_PREFIX = _lit("<|paper_start|> " + "\n".join(latex.PREAMBLE) + "\n\n\\title{")


@query(rf"""WITH p AS (SELECT DISTINCT part_id, p.title, m.abstract, p.intro FROM parsed_parts p LEFT JOIN (SELECT arxiv_id, min(abstract) AS abstract FROM arxiv_metadata GROUP BY 1) m USING (arxiv_id))
  SELECT part_id, md5({_PREFIX} || nullif(trim(title), '') || '}}' || chr(10) || chr(10) || '\begin{{document}}' || chr(10) || chr(10) || '\makefile' || chr(10) || chr(10) || '\begin{{abstract}}' || chr(10) || replace(replace(nullif(trim(abstract), ''), '<|reference_start|>', ''), '<|reference_end|>', '')
    || '\end{{abstract}}' || chr(10) || chr(10) || replace(replace(nullif(intro, ''), 'Introduction' || chr(10), '\section{{Introduction}}' || chr(10) || chr(10)), 'Related Work' || chr(10), '\section{{Related Work}}' || chr(10) || chr(10)) || '\end{{document}} <|paper_end|>') AS paper_md5 FROM p""")
def model_papers(spark: SparkSession, d: str) -> DataFrame:
    """PJ-6, PJ-7: whole papers for the model, from preamble to end marker."""
    m = table(spark, d, "arxiv_metadata").groupBy("arxiv_id").agg(F.min("abstract").alias("abstract"))
    p = table(spark, d, "parsed_parts").select("part_id", "arxiv_id", "title", "intro").distinct().join(m, "arxiv_id", "left")
    return p.select("part_id", F.md5(latex.paper_text(F.col("title"), F.col("abstract"), F.col("intro"))).alias("paper_md5"))


@query(_SQL_TEX + r""" SELECT doc_id, md5('<|paper_start|> ' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\documentclass\{[^}]*\}', '', 'g'), '\\usepackage\{[^}]*\}', '', 'g'), '\\begin\{document\}', '', 'g'), '\\end\{document\}', '', 'g'), '^[ \t\r\f\v\n]+|[ \t\r\f\v\n]+$', '', 'g')) AS h FROM tex""")
def clean_latex(spark: SparkSession, d: str) -> DataFrame:
    """ST-33: a paper for the model."""
    return latex_documents(spark, d).select("doc_id", F.md5(latex.clean_for_model(F.col(_T))).alias("h"))


_COMMANDS = "|".join(sorted(cite.ALL_COMMANDS, key=len, reverse=True))


@query(_SQL_TEX + rf""", k AS (SELECT doc_id, string_split(string_agg(g, ','), ',') AS keys FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\\(?:{_COMMANDS})\*?(?:\[[^\]]*\])*\{{([^}}]+)\}}', 1)) AS g FROM tex) GROUP BY doc_id)
  SELECT doc_id, unnest(list_transform(keys, lambda x: trim(x))) AS key, unnest(range(len(keys))) AS pos FROM k""")
def citations_explode(spark: SparkSession, d: str) -> DataFrame:
    """ST-26, AG-9: cited keys in text order."""
    return latex_documents(spark, d).select("doc_id", F.posexplode(cite.cited_keys(F.col(_T))).alias("pos", "key")).select("doc_id", "key", F.col("pos").cast("long").alias("pos"))


_PYWS = "[\\t-\\r\\x1c-\\x1f \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_NUMBERED = rf"(?:~|{_PYWS})*\\(?:{'|'.join(cite.COMMANDS)})\{{([^}}]+)\}}"


@query(rf"""WITH p AS (SELECT DISTINCT part_id, unnest([intro, related_work]) AS x FROM parsed_parts), s AS (SELECT part_id, string_split_regex(x, '{_NUMBERED}') AS texts, regexp_extract_all(x, '{_NUMBERED}', 1) AS groups FROM p WHERE x IS NOT NULL),
  k AS (SELECT part_id, texts, list_transform(groups, lambda g: string_split(g, ',')) AS keys FROM s),
  n AS (SELECT part_id, texts, keys, list_transform(keys, lambda g, i: CASE WHEN len(g) = 1 THEN ['<|cite_' || i || '|>'] ELSE list_transform(g, lambda _, j: '<|multi_cite_' || i || '_' || j || '|>') END) AS tokens FROM k),
  m AS (SELECT part_id, md5(array_to_string(list_transform(texts, lambda x, i: x || coalesce(array_to_string(tokens[i], ''), '')), '')) AS text_md5, flatten(tokens) AS ts, flatten(keys) AS ks FROM n)
  SELECT part_id, text_md5, unnest(ts) AS token, unnest(list_transform(ks, lambda k: regexp_replace(k, '^{_PYWS}+|{_PYWS}+$', '', 'g'))) AS key, CAST(unnest(range(len(ts))) AS INTEGER) AS pos FROM m WHERE len(ts) > 0""")
def citation_tokens(spark: SparkSession, d: str) -> DataFrame:
    """ST-25: numbered citation tokens of the introductions and related work of parsed_parts, with the text that holds them."""
    parts = table(spark, d, "parsed_parts").select("part_id", F.explode(F.array("intro", "related_work")).alias("x")).filter(F.col("x").isNotNull()).distinct()
    df = parts.select("part_id", cite.extract_citations(F.col("x")).alias("c"))
    return df.select("part_id", F.md5("c.text").alias("text_md5"), F.explode("c.tokens").alias("k")).select("part_id", "text_md5", "k.*")


@query(_SQL_TEX + r""" SELECT doc_id, md5(regexp_replace(t, '~?[ \t\r\f\v\n]*\\(?:citep|citet|cite)(?:[ \t\r\f\v\n]*\[[^\]]*\])?[ \t\r\f\v\n]*\{[^}]+\}', '', 'g')) AS h FROM tex""")
def remove_citations(spark: SparkSession, d: str) -> DataFrame:
    """ST-27: texts without citations."""
    return latex_documents(spark, d).select("doc_id", F.md5(cite.remove_citations(F.col(_T))).alias("h"))


_TOKENS = r"<\|(?:cite_\d+|multi_cite_\d+_\d+)\|>"


@query(rf"""WITH p AS (SELECT DISTINCT part_id, intro FROM parsed_parts WHERE intro IS NOT NULL), s AS (SELECT part_id, string_split(regexp_replace(intro, '({_TOKENS})', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS a FROM p)
  SELECT part_id, len(list_filter(a, lambda x: regexp_full_match(x, '{_TOKENS}'))) AS n_tokens, len(list_filter(a, lambda x: NOT regexp_full_match(x, '{_TOKENS}') AND regexp_matches(x, '[^ \t\r\f\v\n]'))) AS n_texts FROM s""")
def split_with_citations(spark: SparkSession, d: str) -> DataFrame:
    """ST-28: texts and citation tokens in turn."""
    a = F.col("a")
    df = table(spark, d, "parsed_parts").select("part_id", "intro").distinct().filter(F.col("intro").isNotNull()).select("part_id", cite.split_with_citations(F.col("intro")).alias("a"))
    n = F.size(F.filter(a, lambda x: x.rlike(f"^{_TOKENS}$"))).cast("long")
    return df.select("part_id", n.alias("n_tokens"), (F.size(a) - n).cast("long").alias("n_texts"))


@query("""WITH p AS (SELECT DISTINCT row_id, paper FROM train_rows WHERE paper IS NOT NULL)
  SELECT row_id, len(regexp_extract_all(paper, '<\\|cite_start\\|>.*?<\\|cite_end\\|>')) AS n_spans, md5(paper) AS back FROM p""")
def shrink_expand(spark: SparkSession, d: str) -> DataFrame:
    """ST-34: citation spans to marks and back; texts with marks of their own are told by their count of spans only."""
    df = table(spark, d, "train_rows").select("row_id", "paper").distinct().filter(F.col("paper").isNotNull())
    small = cite.shrink_citations(F.col("paper"))
    df = df.withColumn("_s", small)
    return df.select("row_id", F.size("_s.spans").cast("long").alias("n_spans"), F.md5(cite.expand_citations(F.col("_s.text"), F.col("_s.spans"))).alias("back"))


_SPAN = r"(?s)<\|cite_start\|>.*?<\|cite_end\|>"


@query(rf"""WITH p AS (SELECT doc_id, text, string_split_regex(text, '{_SPAN}') AS outside, regexp_extract_all(text, '{_SPAN}') AS spans FROM documents WHERE text IS NOT NULL),
  h AS (SELECT *, regexp_extract(array_to_string(outside, chr(1)), '(?s)^((?:.*?[.!?][ \n]){{3}})', 1) AS h FROM p), g AS (SELECT *, string_split(substr(h, 1, length(h) - 1), chr(1)) AS kept FROM h)
  SELECT doc_id, h <> '' AS enough, md5(CASE WHEN h <> '' THEN array_to_string(list_transform(kept, lambda x, i: CASE WHEN i = 1 THEN x ELSE spans[i - 1] || x END), '') ELSE text END) AS head FROM g""")
def three_sentences(spark: SparkSession, d: str) -> DataFrame:
    """ST-35, SM-1: all documents cut after the third sentence, text inside citation spans ignored."""
    df = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", cite.cut_after_sentences(F.col("text")).alias("c"))
    return df.select("doc_id", "c.enough", F.md5("c.text").alias("head"))


@query("""WITH w AS (SELECT doc_id, string_split(substr(text, 11), ' ') AS w FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: ends_with(x, '.') OR contains(x, '.' || chr(10)))) AS n_ends FROM w""")
def yielded_words(spark: SparkSession, d: str) -> DataFrame:
    """ST-39, FI-16: the words that a text yields behind its first ten characters, and how many of them end a sentence."""
    w = table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", cite.yield_words(F.col("text"), F.lit(10)).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.filter("w", cite.ends_sentence)).cast("long").alias("n_ends"))


_LINE_SPAN = r"<\|cite_start\|>(.*?)<\|cite_end\|>"
_KEY = rf"regexp_replace(regexp_replace(replace(substr(s, 14, 24), ' ', ''), '^:+|:+$', '', 'g'), '[,\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g')"


@query(rf"""WITH p AS (SELECT DISTINCT row_id, paper FROM train_rows WHERE paper IS NOT NULL), s AS (SELECT row_id, string_split_regex(paper, '{_LINE_SPAN}') AS texts, list_transform(regexp_extract_all(paper, '{_LINE_SPAN}', 1), lambda s: {_KEY}) AS keys FROM p),
  c AS (SELECT row_id, array_to_string(list_transform(texts, lambda x, i: CASE WHEN i > 1 AND (i = 2 OR keys[i - 1] <> keys[i - 2]) THEN '\cite{{' || keys[i - 1] || '}}' ELSE '' END || x), '') AS t FROM s),
  m AS (SELECT row_id, replace(replace(regexp_replace(regexp_replace(t, '\\cite\{{([^}}]*)\}}', chr(2) || '\1' || chr(3), 'g'), '\x03{_PYWS}*\x02', ', ', 'g'), chr(2), '\cite{{'), chr(3), '}}') AS t FROM c)
  SELECT row_id, CAST(len(regexp_extract_all(t, '\\cite\{{')) AS INTEGER) AS n_commands, md5(t) AS text_md5 FROM m""")
def cite_and_merge(spark: SparkSession, d: str) -> DataFrame:
    """ST-36, ST-37, ST-38, WN-5: spans as commands, runs merged; spans' own titles serve as keys."""
    spans = F.regexp_extract_all("paper", F.lit(cite.SPAN), 1)
    keys = F.transform(spans, lambda s: F.substring(s, 14, 24))
    df = table(spark, d, "train_rows").select("row_id", "paper").distinct().filter(F.col("paper").isNotNull())
    done = cite.merge_citations(cite.replace_citations(F.col("paper"), keys))
    return df.select("row_id", F.regexp_count(done, F.lit(r"\\cite\{")).alias("n_commands"), F.md5(done).alias("text_md5"))


@query(r"""WITH p AS (SELECT DISTINCT part_id, unnest(list_filter(bbl_items, lambda x: x IS NOT NULL)) AS item FROM parsed_parts)
  SELECT part_id, trim(regexp_extract(regexp_replace(item, '[ \t\r\f\v\n]+', ' ', 'g'), '\\bibitem *(?:\[(?:[^\[\]]|\{[^{}]*\})*\])? *\{([^}]+)\}', 1)) AS key, md5(item) AS item_md5 FROM p WHERE regexp_matches(item, '\\bibitem *(?:\[(?:[^\[\]]|\{[^{}]*\})*\])? *\{([^}]+)\}')""")
def bibitem_keys(spark: SparkSession, d: str) -> DataFrame:
    """ST-21: keys of bibliography items."""
    df = table(spark, d, "parsed_parts").select("part_id", F.explode("bbl_items").alias("item")).distinct().filter(F.col("item").rlike(r"\\bibitem"))
    return df.select("part_id", bib.bibitem_key(F.col("item")).alias("key"), F.md5("item").alias("item_md5"))


@query(r"""WITH p AS (SELECT DISTINCT part_id, unnest(list_filter(bib_items, lambda x: x IS NOT NULL)) AS item FROM parsed_parts)
  SELECT part_id, nullif(trim(regexp_extract(item, '@\w+\s*\{([^,]+),', 1)), '') AS key, nullif(trim(regexp_extract(item, '(?is)(?:^|[^A-Za-z])title\s*=\s*[{"]+([^}"]+)[}"]', 1)), '') AS title FROM p""")
def bib_items(spark: SparkSession, d: str) -> DataFrame:
    """ST-20: keys and titles of entries."""
    df = table(spark, d, "parsed_parts").select("part_id", F.explode("bib_items").alias("item")).distinct().filter(F.col("item").isNotNull())
    return df.select("part_id", bib.entry_key(F.col("item")).alias("key"), bib.entry_title(F.col("item")).alias("title"))


@query(r"""SELECT DISTINCT id, lower(regexp_extract(bibtex, '@(\w+)', 1)) AS type, trim(regexp_extract(bibtex, '\{([^,]+),', 1)) AS key, regexp_extract(bibtex, 'year\s*=\s*\{([^}]*)\}', 1) AS year, len(regexp_extract_all(bibtex, '(?m)^\s*\w+\s*=')) AS n_fields FROM bibtex""")
def parse_bibtex(spark: SparkSession, d: str) -> DataFrame:
    """ST-22: type, key and fields of entries."""
    df = table(spark, d, "bibtex").dropDuplicates(["id", "bibtex"]).select("id", bib.entry_fields(F.col("bibtex")).alias("e"))
    return df.select("id", "e.type", "e.key", F.element_at("e.fields", F.lit("year")).alias("year"), F.size("e.fields").cast("long").alias("n_fields"))


@query()
def bib_sections(spark: SparkSession, d: str) -> DataFrame:
    """ST-17, ST-18, ST-19, ST-23, ST-24: items of the bib sections, by format, with entries made of bare items."""
    df = table(spark, d, "parsed_parts").select("part_id", "bib").distinct().filter(F.length("bib") > 0)
    bare = bib.bbl_items(F.col("bib"))
    each = df.select("part_id", F.size(bib.formal_entries(F.col("bib"))).alias("n_formal"), F.size(bib.bib_entries(F.col("bib"))).alias("n_entries"), F.explode_outer(bare).alias("item"))
    return each.select("part_id", "n_formal", "n_entries", bib.bibitem_as_entry(F.col("item")).alias("entry"))


@query("""SELECT DISTINCT corpus_id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g')) AS norm FROM corpus_data WHERE title IS NOT NULL""")
def normalize_titles(spark: SparkSession, d: str) -> DataFrame:
    """ST-14: keys of exact matching."""
    return table(spark, d, "corpus_data").filter(F.col("title").isNotNull()).select("corpus_id", titles.normalize_title(F.col("title")).alias("norm")).distinct()


def _replaced(t: str) -> str:
    """The written replacements, one after the other, in SQL."""
    for a, b in [*((x, "") for x in titles.DROPPED), *titles.REPLACED.items()]:
        t = f"replace({t}, {_lit(a)}, {_lit(b)})"
    return t


_WORDS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}"


@query(rf"""WITH c AS (SELECT DISTINCT arxiv_id, pos, title FROM citations WHERE title IS NOT NULL), x AS (SELECT arxiv_id, pos, trim(regexp_replace({_replaced('title')}, '{_UWS}+', ' ', 'g')) AS t FROM c)
  SELECT arxiv_id, pos, lower(trim(regexp_replace(t, '[^{_WORDS}\t-\r \x{{85}}\x{{A0}}\-.,;:!?&()\[\]"''/$]', '', 'g'))) AS key FROM x""")
def citation_titles(spark: SparkSession, d: str) -> DataFrame:
    """ST-13: join keys of cited titles."""
    return table(spark, d, "citations").filter(F.col("title").isNotNull()).select("arxiv_id", "pos", "title").distinct().select("arxiv_id", "pos", titles.join_title(F.col("title")).alias("key"))
