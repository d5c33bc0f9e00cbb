"""Citations in LaTeX and in marked-up papers. Built-in columns where they suffice, Arrow batches where order needs a counter."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Citation commands in the order in which they are numbered.
COMMANDS = ["cite", "citep", "citet", "citeyear", "citeauthor", "citealt", "citealp", "citenum"]
#: Commands of the wide inventory, in text order, with options and stars.
ALL_COMMANDS = ["cite", "citet", "citep", "citealp", "citeauthor", "citeyear", "citealt", "parencite", "textcite", "autocite", "citenum", "citeyearpar", "citetext", "citepalias", "citetalias", "smartcite", "footcite", "footcitetext", "supercite", "cites", "parencites", "textcites", "autocites", "nocite", "citefield", "citereset"]
SPAN = r"<\|cite_start\|>(.*?)<\|cite_end\|>"
_NUMBERED = re.compile("|".join(rf"(?P<c{i}>(?:~|\s)*\\{c}\{{([^}}]+)\}})" for i, c in enumerate(COMMANDS)))

_TOKEN = T.StructType([T.StructField("token", T.StringType()), T.StructField("key", T.StringType()), T.StructField("pos", T.IntegerType())])
NUMBERED = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(_TOKEN))])


def number_citations(text: str | None, by_command: bool = False) -> tuple[str | None, list[dict]]:
    """The text with citation tokens, and (token, key, pos) of each cited key.

    One key gives <|cite_n|>, several give <|multi_cite_n_i|>; blanks and ties before a command go with it. Numbers
    follow the text, or with ``by_command`` first the order of the commands. Empty keys of a trailing comma are kept.
    """
    if text is None:
        return None, []
    found = [[m.start(), m.end(), int(m.lastgroup[1:]) if m.lastgroup else 0, m] for m in _NUMBERED.finditer(text)]
    order = sorted(found, key=lambda f: f[2]) if by_command else found
    out, number = [], {}
    for n, f in enumerate(order, 1):
        keys = re.search(r"\{([^}]+)\}$", f[3][0])[1].split(",")
        names = [f"<|cite_{n}|>"] if len(keys) == 1 else [f"<|multi_cite_{n}_{i}|>" for i in range(1, len(keys) + 1)]
        number[f[0]] = "".join(names)
        out += [(t, k.strip()) for t, k in zip(names, keys)]
    parts, last = [], 0
    for a, b, _, _ in found:
        parts += [text[last:a], number[a]]
        last = b
    return "".join(parts) + text[last:], [{"token": t, "key": k, "pos": p} for p, (t, k) in enumerate(out)]


@F.pandas_udf(NUMBERED)
def extract_citations(texts: pd.Series) -> pd.DataFrame:
    """(text with tokens, tokens in order) of each text."""
    rows = [number_citations(t) for t in texts]
    return pd.DataFrame({"text": [r[0] for r in rows], "tokens": [r[1] for r in rows]})


@F.pandas_udf(NUMBERED)
def extract_citations_by_command(texts: pd.Series) -> pd.DataFrame:
    """As extract_citations, numbered by command first."""
    rows = [number_citations(t, True) for t in texts]
    return pd.DataFrame({"text": [r[0] for r in rows], "tokens": [r[1] for r in rows]})


def cited_keys(c: Column) -> Column:
    """Cited keys in text order with repeats, from all commands with any options and stars; null gives null."""
    pattern = rf"\\(?:{'|'.join(sorted(ALL_COMMANDS, key=len, reverse=True))})\*?(?:\[[^\]]*\])*\{{([^}}]+)\}}"
    return F.transform(F.flatten(F.transform(F.regexp_extract_all(c, F.lit(pattern), 1), lambda g: F.split(g, ","))), lambda k: F.trim(k))


def remove_citations(c: Column) -> Column:
    """Without citation commands, their options and the tie and blanks before them."""
    return F.regexp_replace(c, r"~?\s*\\(?:citeauthor|citeyear|parencite|textcite|autocite|citealp|citealt|cites|citet|citep|cite)(?:\s*\[[^\]]*\])?\s*\{[^}]+\}", "")


def split_with_citations(c: Column) -> Column:
    """Texts and citation tokens in turn; texts are trimmed and dropped where empty."""
    token = r"<\|(?:cite_\d+|multi_cite_\d+_\d+)\|>"
    marked = F.regexp_replace(c, f"({token})", "\x01$1\x01")
    return F.filter(F.transform(F.split(marked, "\x01"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def shrink_citations(c: Column) -> Column:
    """(text with $i$ for the i-th citation span, spans): the inverse is ``expand_citations``."""
    spans = F.regexp_extract_all(c, F.lit(SPAN), 1)
    parts = F.split(c, SPAN)
    text = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("$"), (i - 1).cast("string"), F.lit("$"), p))), "")
    return F.struct(text.alias("text"), spans.alias("spans"))


def expand_citations(text: Column, spans: Column) -> Column:
    """Put the spans back; a text that holds a literal $i$ of its own would get one there too."""
    entries = F.transform(spans, lambda s, i: F.struct(F.concat(F.lit("$"), i.cast("string"), F.lit("$")).alias("a"), F.concat(F.lit("<|cite_start|>"), s, F.lit("<|cite_end|>")).alias("b")))
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e.a, e.b))


def cut_after_sentences(c: Column, n: int = 3) -> Column:
    """(enough, text): the text up to the n-th sentence end before a blank or line end, citation spans not counted."""
    spans, mark = F.regexp_extract_all(c, F.lit(SPAN), 1), "\uffff"  # no character, so no text holds it
    head = F.regexp_extract(F.array_join(F.split(c, SPAN), mark), rf"(?s)^((?:.*?[.!?](?=[ \n])){{{n}}})", 1)
    span = lambda i: F.concat(F.lit("<|cite_start|>"), F.get(spans, i - 1), F.lit("<|cite_end|>"))
    full = F.array_join(F.transform(F.split(head, mark), lambda p, i: F.when(i == 0, p).otherwise(F.concat(span(i), p))), "")
    enough = head != ""
    return F.struct(enough.alias("enough"), F.when(enough, full).otherwise(c).alias("text"))


def back_to_sentence(c: Column) -> Column:
    """Up to the last full stop before a line end; the text itself where there is none."""
    found = F.regexp_extract(c, r"(?s)^(.*\.)\n", 1)
    return F.when(found != "", found).otherwise(c)


def ends_sentence(word: Column) -> Column:
    """Whether a word ends a sentence."""
    return word.endswith(".") | F.contains(word, F.lit(".\n"))


def replace_citations(c: Column, keys: Column) -> Column:
    r"""The i-th citation span as \cite{key_i}; a span with the key of the one before it and spans beyond the keys are dropped."""
    from scholarmill.functions.titles import citation_key

    parts = F.split(c, SPAN)
    clean = F.transform(keys, citation_key)
    cite = lambda i: F.when((i <= F.size(clean)) & ((i == 1) | (F.get(clean, i - 1) != F.get(clean, i - 2))), F.concat(F.lit("\\cite{"), F.get(clean, i - 1), F.lit("}"))).otherwise("")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(cite(i), p))), "")


def merge_citations(c: Column) -> Column:
    r"""Runs of \cite{} with only white space between them as one \cite{a, b}."""
    marked = F.regexp_replace(c, r"\\cite\{([^}]*)\}", "\x02$1\x03")
    joined = F.regexp_replace(marked, "(?U)\x03\\s*\x02", ", ")
    return F.replace(F.replace(joined, F.lit("\x02"), F.lit("\\cite{")), F.lit("\x03"), F.lit("}"))


def yield_words(text: Column, done: Column) -> Column:
    """What comes after the first ``done`` characters, at single blanks."""
    return F.split(F.substring(text, done + 1, F.length(text)), " ")


def reference_span(title_abstract: Column) -> Column:
    """A citation span with its reference, after a blank."""
    return F.concat(F.lit(" <|cite_start|> (Reference: "), title_abstract, F.lit(") <|cite_end|>"))


def as_reference(span: Column) -> Column:
    """The inverse form: a training target."""
    return F.replace(F.replace(span, F.lit("<|cite_start|> (Reference: "), F.lit("<|reference_start|> ")), F.lit(") <|cite_end|>"), F.lit(" <|reference_end|>"))
