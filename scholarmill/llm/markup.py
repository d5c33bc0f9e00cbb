"""Markup residue in texts: deducing its templates, finding it by them, and turning it into clean text.

A lexer cuts each value (a page) into tokens of markup and text. Tokens of one form start as one token (``any command``)
and are told apart by name. Tokens that occur equally often in every page of a dialect, so that their occurrence vectors
agree, form an equivalence class. A class is valid if it has support and its tokens stand in one order and in turn in
every page; the class of a form that the grammar lists needs no support. A class whose occurrences all lie within those of
another nests in it: the valid classes are the template of the dialect. A value is marked up if it holds a token of a
valid class. Cleaning takes these tokens out and keeps the slots between them, headings, lists, code and formulas as such.
What has the form of an element or a bracketed mark but isn't in the grammar is a loose token; it belongs to the template
only where its class is valid and holds both ends of the pair.
"""

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarmill.plans.stage import stage

# What only looks like markup: file paths, amounts of money, the project's tokens, comparisons.
PATH = re.compile(r"\b[A-Za-z]:\\[^\s<>|\"]*|(?<![\w\\])\\\\[\w.-]+\\[^\s<>|\"]*")
TOKEN = re.compile(r"<\|[^|<>\s]{1,40}\|>")
# Element names of HTML and of wikis.
TAGS = "a abbr article aside b big blockquote body br caption center cite code col dd del details div dl dt em figcaption figure font footer h1 h2 h3 h4 h5 h6 head header hr html i img ins kbd li link main mark math meta nav nowiki ol p pre q ref references s samp script section small source span strike strong style sub sup syntaxhighlight table tbody td tfoot th thead time title tr tt u ul var wbr gallery poem blockquote"
GRAMMAR = {
    "html": {
        "comment": r"<!--.*?-->",
        "tag": rf"</?(?:{'|'.join(TAGS.split())})(?:\s[^<>]*)?/?>",
        "entity": r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});",
    },
    "latex": {
        "display": r"\$\$[^$]+\$\$|\\\[.*?\\\]",
        "inline": r"\\\(.*?\\\)|(?<![\\$\w])\$(?=[^$\n]*[\\_^{}=])(?!\s)[^$\n]+(?<!\s)\$(?!\d)|(?<![\\$\w])\$[A-Za-z]\w?'?\$(?!\w)",
        "frame": r"\\(?:begin|end)\s*\{[A-Za-z]+\*?\}",
        "command": r"\\[A-Za-z]+\*?",
        "accent": r"\\[\"'`^~=.](?:\{\\?[A-Za-z]\}|\\?[A-Za-z])",
        "escape": r"\\[%&_#${}]",
        "quote": r"``[^`\n]+?''",
        "remark": r"(?m:(?:^|(?<=[^\d\s\\])\s)%(?!\d)[^\n]*$)",
    },
    "markdown": {
        "fence": r"(?m:^(?:```|~~~)[^\n]*$)",
        "heading": r"(?m:^#{1,6}[ \t]+\S[^\n]*$)",
        "code": r"(?<![`\w])`[^`\n]+`(?![`\w'])",
        "strong": r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w)",
        "strike": r"~~(?=\S)[^~\n]+~~",
        "emphasis": r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w_\\])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])",
        "link": r"!?\[[^\[\]\n]*\]\([^)\s]*(?:\s+\"[^\"]*\")?\)",
        "note": r"\[\^[\w-]+\]:?",
        "list": r"(?m:^[ \t]*(?:[-*+]|\d{1,3}\.)[ \t]+(?=\S))",
        "block": r"(?m:^>[ \t]?(?=\S))",
        "rule": r"(?m:^(?:-{3,}|\*{3,}|_{3,})[ \t]*$)",
        "row": r"(?m:^\|[^\n]*\|[ \t]*$)",
    },
    "wiki": {
        "heading": r"(?m:^(={2,6})[^=\n][^\n]*?\1[ \t]*$)",
        "link": r"\[\[[^\[\]\n]+\]\]|\[https?://[^\s\]]+(?: [^\]\n]*)?\]",
        "template": r"\{\{[^{}]*\}\}",
        "emphasis": r"'{2,5}(?=[^'\s])[^\n]*?(?<=[^'\s])'{2,5}",
        "list": r"(?m:^[*#:;]{1,5}[ \t]+(?=\S))",
        "table": r"(?m:^(?:\{\||\|\}|\|-)[^\n]*$)",
    },
}
ORDER = [("html", "comment"), ("latex", "display"), ("latex", "inline"), ("markdown", "fence"), ("latex", "frame"), ("html", "tag"), ("html", "entity"), ("latex", "quote"), ("latex", "remark"), ("latex", "escape"), ("latex", "accent"), ("latex", "command"), ("wiki", "heading"), ("wiki", "template"), ("wiki", "table"), ("wiki", "link"), ("wiki", "emphasis"), ("markdown", "heading"), ("markdown", "strong"), ("markdown", "strike"), ("markdown", "link"), ("markdown", "note"), ("markdown", "code"), ("markdown", "rule"), ("markdown", "row"), ("markdown", "block"), ("markdown", "list"), ("wiki", "list"), ("markdown", "emphasis")]
#: What a token can begin with; only there the alternatives are tried.
STARTS = r"(?=[<&\\$`#*_~!\[>|{'%:;+=\-]|\s%|(?m:^)[ \t\d])"
SCAN = re.compile(STARTS + "(?:" + "|".join(f"(?P<{d}_{k}>{GRAMMAR[d][k]})" for d, k in ORDER if (d, k) != ("wiki", "heading")) + ")", re.S | re.I)
#: Forms whose slot can hold other tokens.
HOLDERS = {"strong", "strike", "emphasis", "link", "quote", "heading", "row", "block", "template", "table"}
WIKI_HEADING = re.compile(GRAMMAR["wiki"]["heading"])
# What the grammar doesn't list, as an element or a bracketed mark of any name.
LOOSE = re.compile(r"<(?P<a>/?[A-Za-z][\w:.-]{0,40})(?:\s[^<>]*)?>|\[(?P<b>/?[A-Za-z][A-Za-z0-9]{0,20})(?:=[^\[\]\n]*)?\]")
FRAME = "frame"  #: the dialect of loose tokens
BIBTEX = re.compile(r"^\s*@\w+\s*\{", re.M)
ENTRY = re.compile(r"^\s*@\w+\s*\{[^,\n]*,?|^\s*\w+\s*=\s*\{|\}\s*,?\s*$", re.M)


#: What opens and closes a stretch over lines.
OVER_LINES = (("<!--", "-->"), ("\\[", "\\]"), ("\\(", "\\)"))
STRETCHES = (*OVER_LINES, *((f"<{t}", f"</{t}>") for t in ("pre", "syntaxhighlight", "math", "span")), *((f"\\begin{{{e}", f"\\end{{{e}") for e in ("verbatim", "lstlisting", "minted", "equation", "align", "gather", "displaymath", "eqnarray", "multline")))


def shut(text: str, pairs: tuple[tuple[str, str], ...], new: str = " ") -> str:
    """The text with the first sign of each opening behind the last closing replaced: it opens nothing, and need not be tried."""
    low = text.lower()
    if len(low) != len(text):
        low = text
    for a, b in pairs:
        at = low.find(a, max(0, low.rfind(b)))
        if at >= 0:
            text = text[:at] + new + text[at + 1 :].replace(a, new + a[1:])
            low = text.lower() if len(text.lower()) == len(text) else text
    return text


def masked(text: str) -> str:
    """The text with what only looks like markup blanked out, at the same positions."""
    blank = lambda m: " " * len(m[0])
    text = shut(TOKEN.sub(lambda m: "\x00" * len(m[0]), PATH.sub(blank, text)), OVER_LINES)
    if BIBTEX.search(text):
        text = re.sub(r"\{(?=\{)|(?<=\})\}", " ", ENTRY.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text))
    return text


def _scan(t: str, low: int, high: int, taken: set[int]) -> Iterator[tuple[str, str, str, int, int]]:
    at = low
    while m := SCAN.search(t, at, high):
        a, at = m.start(), max(m.end(), m.start() + 1)
        if a in taken:
            continue
        dialect, form = m.lastgroup.split("_", 1)
        name = form
        if form == "tag":
            name = re.match(r"</?\w+", m[0])[0].lower() + (" class" if "class=" in m[0] else "") + ">"
        elif form in ("command", "frame", "entity"):
            name = m[0]
        yield dialect, form, name, a, m.end()
        if form in HOLDERS and m.end() - a > 2:
            yield from _scan(t, a + 1 + len(re.match(r"\W*", m[0][1:])[0]), m.end() - 1, taken)


def tokens(text: str | None) -> list[tuple[str, str, str, int, int]]:
    """(dialect, form, token, start, end) of the markup in a text; the token without what it holds. None for a null text."""
    if not text:
        return []
    t = masked(text)
    out = [("wiki", "heading", "heading", m.start(), m.end()) for m in WIKI_HEADING.finditer(t)] if "==" in t else []
    taken = {p for *_, a, b in out for p in (a, b - 1)}
    return sorted([*out, *_scan(t, 0, len(t), taken)], key=lambda x: (x[3], -x[4]))


# --- cleaning ---------------------------------------------------------------------------------------------------------

CODE = re.compile(
    r"\\begin\{(?:verbatim|lstlisting|minted)\*?\}(?:\[[^\]]*\])?(?:\{\w+\})?\n?(?P<a>.*?)\n?\\end\{(?:verbatim|lstlisting|minted)\*?\}|"
    r"(?:<pre[^>]*>\s*(?:<code[^>]*>)?|<syntaxhighlight[^>]*>)\n?(?P<b>.*?)\n?(?:</code>\s*)?(?:</pre>|</syntaxhighlight>)|^```[^\n]*\n(?P<c>.*?)\n?^```[ \t]*$",
    re.S | re.M | re.I,
)
FORMULA = re.compile(
    r"<span[^>]*class=\"?math[^>]*>\s*(?:\\\(|\\\[)?(?P<a>.*?)(?:\\\)|\\\])?\s*</span>(?:<!--.*?-->)?|<math[^>]*>(?P<b>.*?)</math>|\\\((?P<c>.*?)\\\)|"
    r"(?<![\\$\w])\$(?!\$)(?=[^$\n]*[\\_^{}=])(?!\s)(?P<d>[^$\n]+)(?<!\s)\$(?!\d)|(?<![\\$\w])\$(?P<g>[A-Za-z]\w?'?)\$(?!\w)|"
    r"\$\$(?P<e>[^$]+)\$\$|\\\[(?P<f>.*?)\\\]|\\begin\{(?P<env>equation|align|gather|displaymath|eqnarray|multline)\*?\}(?P<h>.*?)\\end\{(?P=env)\*?\}",
    re.S,
)
ACCENT = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", ".": "\u0307"}
#: (what a text must hold for the rule to apply, pattern, replacement)
RULES: list[tuple[str, re.Pattern, object]] = [
    ("-->", re.compile(r"<!--.*?-->", re.S), ""),
    ("%", re.compile(GRAMMAR["latex"]["remark"]), ""),
    ("\\", re.compile(r"\\(?:label|vspace|hspace|index|pagestyle|bibliographystyle|bibliography)\*?\{[^{}]*\}"), ""),
    ("\\", re.compile(r"~?\\(?:cite\w*)\*?(?:\[[^\]]*\])*\{([^{}]*)\}"), lambda m: f" [{m[1]}]"),
    ("\\", re.compile(r"\\bibitem(?:\[[^\]]*\])?\{([^{}]*)\}"), lambda m: f"[{m[1]}]"),
    ("\\", re.compile(r"\\(?:ref|eqref|autoref)\{([^{}]*)\}"), lambda m: m[1]),
    ("\\", re.compile(r"\\(?:chapter|section)\*?\{((?:[^{}]|\{[^{}]*\})*)\}"), lambda m: f"\n# {m[1]}\n"),
    ("\\", re.compile(r"\\subsection\*?\{((?:[^{}]|\{[^{}]*\})*)\}"), lambda m: f"\n## {m[1]}\n"),
    ("\\", re.compile(r"\\(?:subsubsection|paragraph)\*?\{((?:[^{}]|\{[^{}]*\})*)\}"), lambda m: f"\n### {m[1]}\n"),
    ("</", re.compile(r"<h([1-6])[^>]*>(.*?)</h\1>", re.S | re.I), lambda m: f"\n{'#' * int(m[1])} {m[2].strip()}\n"),
    ("==", re.compile(r"^(={2,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M), lambda m: f"{'#' * (len(m[1]) - 1)} {m[2]}"),
    ("\\", re.compile(r"\\begin\{\w+\*?\}(?:\[[^\]]*\])?|\\end\{\w+\*?\}"), "\n"),
    ("\\", re.compile(r"\\item(?:\[([^\]]*)\])?[ \t]*"), lambda m: "- " + (m[1] + " " if m[1] else "")),
    ("<", re.compile(r"\s*<li[^>]*>\s*", re.I), "\n- "),
    ("", re.compile(r"^[ \t]*(?:[*+-]|[*#:;]{1,5})[ \t]+(?=\S)(?<!# )", re.M), lambda m: m[0] if m[0].startswith("#") else "- "),
    ("<", re.compile(r"<br\s*/?>", re.I), "\n"),
    ("<", re.compile(r"</(?:p|div|ul|ol|tr|table|blockquote|dd|dt)>", re.I), "\n\n"),
    ("</", re.compile(r"<ref[^>/]*>(.*?)</ref>", re.S | re.I), lambda m: f" ({m[1]})"),
    ("\\", re.compile(r"\\footnote\{((?:[^{}]|\{[^{}]*\})*)\}"), lambda m: f" ({m[1]})"),
    ("<", re.compile(rf"</?(?:{'|'.join(TAGS.split())})(?:\s[^<>]*)?/?>", re.I), ""),
    ("[^", re.compile(r"\[\^[\w-]+\]:?"), ""),
    ("](", re.compile(r"!?\[([^\[\]\n]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)"), lambda m: m[1]),
    ("[[", re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]"), lambda m: m[1]),
    ("[http", re.compile(r"\[https?://\S+ ([^\]\n]*)\]"), lambda m: m[1]),
    ("**", re.compile(r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*"), lambda m: m[1]),
    ("__", re.compile(r"(?<!\w)__(?=\S)([^_\n]+?)(?<=\S)__(?!\w)"), lambda m: m[1]),
    ("*", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]*?)(?<=[^\s*])\*(?![\w*])"), lambda m: m[1]),
    ("_", re.compile(r"(?<![\w_\\])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w_])"), lambda m: m[1]),
    ("``", re.compile(r"``([^`\n]+?)''"), lambda m: f"“{m[1]}”"),
    ("''", re.compile(r"'{2,5}(?=[^'\s])([^'\n]*?)'{2,5}"), lambda m: m[1]),
    ("\\", re.compile(r"\\([\"'`^~=.])(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))"), lambda m: (m[2] or m[3]) + ACCENT[m[1]]),
    ("\\", re.compile(r"\\newblock\s*|\{\\(?:it|bf|em|tt|sc|rm|sl)\s+|\\\\(?:\[[^\]]*\])?"), ""),
    ("\\", re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}"), lambda m: m[1]),
    ("\\", re.compile(r"\\[A-Za-z]+\*?(?=[^A-Za-z\\]|$)[ \t]?"), ""),
    ("\\", re.compile(r"\\([%&_#${}])"), lambda m: m[1]),
]
TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
BRACES = re.compile(r"\{([^{}\n]*)\}")
ARGUMENTS = re.compile(r"(?:\[[^\[\]]*\]|\{[^{}]*\})*")
HOLE = re.compile("\ue000(\\d+)\ue001")


SHUT = {"<": "\ue002", "\\": "\ue003"}  #: what stands for the first sign of an opening that opens nothing


def opened(text: str, again: bool) -> str:
    """The text with openings that open nothing marked, or with the marks taken back."""
    for sign, mark in SHUT.items():
        text = text.replace(mark, sign) if again else shut(text, tuple(p for p in STRETCHES if p[0][0] == sign), mark)
    return text


def clean(text: str | None, template: set[tuple[str, str]] | None = None) -> str | None:
    """Clean text of a value: Markdown headings and lists, fenced code, formulas between dollars, no other markup.

    ``template`` has the (dialect, token) that are markup, tokens by their own name or by that of their form; None stands
    for the whole grammar. Tokens outside of it stay as they are. Null stays null and a value without markup stays as it
    is. Footnotes and notes follow in parentheses, citation commands become their keys in brackets.
    """
    import unicodedata

    held: list[str] = []

    def hold(s: str) -> str:
        held.append(s)
        return f"\ue000{len(held) - 1}\ue001"

    if not text:
        return text
    if template is not None:
        text = without_frame(text, {t for d, t in template if d == FRAME})
        found = tokens(text)
        others = [x for x in found if (x[0], x[2]) not in template and (x[0], f"any {x[1]}") not in template]
        if len(others) == len(found):
            return text
        out, at = [], 0
        for _, form, _, a, b in others:
            b = ARGUMENTS.match(text, b).end() if form == "command" else b
            if a >= at:
                out += [text[at:a], hold(text[a:b])]
                at = b
        text = "".join(out) + text[at:]
    elif not tokens(text):
        return text
    bibtex = bool(BIBTEX.search(text))
    text = TOKEN.sub(lambda m: hold(m[0]), PATH.sub(lambda m: hold(m[0]), text))
    text = opened(text, False)
    text = CODE.sub(lambda m: "\n" + hold("```\n" + html.unescape(m["a"] or m["b"] or m["c"] or "") + "\n```") + "\n", text)
    text = FORMULA.sub(lambda m: hold(f"$${m['e'] or m['f'] or m['h']}$$" if m["e"] or m["f"] or m["h"] else f"${m['a'] or m['b'] or m['c'] or m['d'] or m['g'] or ''}$"), text)
    text = opened(text, True)
    text = re.sub(r"(?<![`\w])`([^`\n]+)`(?![`\w'])", lambda m: hold(m[0]), text)
    text = re.sub(r"<code[^>]*>([^<\n]*)</code>|\\texttt\{([^{}]*)\}", lambda m: hold(f"`{m[1] or m[2] or ''}`"), text)
    if not bibtex:
        text = TEMPLATE.sub("", text)
    for need, pattern, new in RULES:
        if need in text:
            text = pattern.sub(new, text)
    if not bibtex:
        for _ in range(3):
            text = BRACES.sub(r"\1", text)
    text = html.unescape(text).replace("\xa0", " ").replace("~", " ")
    while HOLE.search(text):
        text = HOLE.sub(lambda m: held[int(m[1])], text)
    lines = [re.sub(r"(?<=\S)[ \t]{2,}", " ", line.rstrip()) for line in text.split("\n")]
    return unicodedata.normalize("NFC", re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip())


def loose(text: str | None, found: list[tuple[str, str, str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """(token, start, end) of the loose tokens of a text: outside of code, formulas and all tokens of the grammar."""
    if not text or not LOOSE.search(t := masked(text)):
        return []
    taken = bytearray(len(text))
    spans = [(a, b) for *_, a, b in (tokens(text) if found is None else found)] + [m.span() for p in (CODE, FORMULA) for m in p.finditer(shut(text, STRETCHES))]
    for a, b in spans:
        taken[a:b] = b"\1" * (b - a)
    return [(f"<{m['a']}>" if m["a"] else f"[{m['b']}]", m.start(), m.end()) for m in LOOSE.finditer(t) if 1 not in taken[m.start() : m.end()]]


def without_frame(text: str, frame: set[str]) -> str:
    """A text without the loose tokens in ``frame``; slots that follow one another stand on lines of their own."""
    out, at, closed = [], 0, False
    for token, a, b in loose(text) if frame else []:
        if token not in frame:
            continue
        slot, close = text[at:a], token[1] == "/"
        out.append("\n" if closed and not close and not slot.strip() and "\n" not in slot else slot)
        at, closed = b, close
    return "".join(out) + text[at:]


# --- templates --------------------------------------------------------------------------------------------------------

SUPPORT = 3  #: pages that a class of names must occur in

Mark = tuple[str, str | None, str, int, int]


def all_tokens(text: str | None) -> list[Mark]:
    """The tokens of a text, loose ones too (without a form), in order."""
    found = tokens(text)
    return sorted([*found, *((FRAME, None, t, a, b) for t, a, b in loose(text, found))], key=lambda x: (x[3], -x[4]))


def spans(found: list[Mark]) -> list[int]:
    """Where the span of each token ends: at its own end, that of an opening one at the end of its closing one."""
    ends = [b for *_, b in found]
    opened: dict[tuple[str, str], list[int]] = {}
    for k, (dialect, form, name, _, b) in enumerate(found):
        if form == "frame":
            kind, close = name[name.index("{") :], name.startswith("\\end")
        elif form in ("tag", None):
            kind, close = re.sub(r"[^\w:.-]| class", "", name), name[1] == "/"
        else:
            continue
        stack = opened.setdefault((dialect, kind), [])
        if not close:
            stack.append(k)
        elif stack:
            ends[stack.pop()] = b
    return ends


def parents(found: list[Mark]) -> list[int]:
    """For each token the one whose span holds it, the innermost; -1 at the top."""
    ends, out, stack = spans(found), [], []
    for k, (*_, a, b) in enumerate(found):
        while stack and ends[stack[-1]] < max(b, a + 1):
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(k)
    return out


def values(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, value) of the non-empty values, each once."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("_v")
    return df.select(F.col(key), each).select(key, "_v.*").filter(F.length("value") > 0).distinct()


def _page(key: str):
    return F.xxhash64(key, "field", "value").alias("page")


def pages(vals: DataFrame, key: str) -> DataFrame:
    """(key, field, page, dialect, form, token, at, within): a row for each distinct token of each value, loose ones too.

    ``at`` has the token's positions, ``within`` the tokens that hold it (dialect, tab, token; empty at the top). The form
    is given as a name, ``any command``; loose tokens have none. Values without a token have no row.
    """
    shape = f"`{key}` {dict(vals.dtypes)[key]}, field string, page long, dialect string, form string, token string, at array<int>, within array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rows = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                found = all_tokens(text)
                own: dict[tuple[str, str], tuple[str | None, list[int], set[str]]] = {}
                for (dialect, form, token, a, _), p in zip(found, parents(found)):
                    _, at, within = own.setdefault((dialect, token), (form, [], set()))
                    at.append(a)
                    within.add("\t".join((found[p][0], found[p][2])) if p >= 0 else "")
                for (dialect, token), (form, at, within) in own.items():
                    row.append(i)
                    rows.append((dialect, form and f"any {form}", token, at, sorted(within)))
            take = pa.array(row, pa.int64())
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[key, "field", "page", "dialect", "form", "token", "at", "within"])

    return vals.select(key, "field", _page(key), "value").mapInArrow(run, shape)


def _names(paged: DataFrame) -> DataFrame:
    """(dialect, name, vector, n_pages): the distinct tokens, staged so that what joins them knows how few they are.

    A token's occurrence vector is told by the sum of the hashes of its (page, count), which needs no vector in any one
    place.
    """
    vector = F.sum(F.xxhash64("page", F.size("at")).cast("decimal(38,0)")).alias("vector")
    return stage(paged.groupBy("dialect", F.col("token").alias("name")).agg(vector, F.count(F.lit(1)).alias("n_pages")))


def _grouped(names: DataFrame) -> DataFrame:
    found = names.groupBy("dialect", "vector").agg(F.array_sort(F.collect_set("name")).alias("tokens"), F.min("n_pages").alias("n_pages"))
    return found.select("dialect", F.md5(F.concat_ws(" ", "dialect", F.array_join("tokens", " "))).alias("class_id"), "tokens", "n_pages")


def classes(paged: DataFrame) -> DataFrame:
    """(dialect, class_id, tokens, n_pages, valid): the equivalence classes of tokens, of the names and of the forms.

    A class of names is valid if it occurs in SUPPORT pages and, in each, its tokens stand in the same order and in turn;
    the class of a form, whose beginning and end always occur in turn, is valid as the grammar lists it.
    """
    found = _grouped(_names(paged))
    # the order of classes of several names, page by page
    size = F.size("tokens")
    several = found.filter((size > 1) & (F.col("n_pages") >= SUPPORT)).select("dialect", "class_id", size.alias("size"), F.explode("tokens").alias("token"))
    each = paged.join(several, ["dialect", "token"]).select("page", "class_id", "size", F.transform("at", lambda a: F.struct(a.alias("a"), F.col("token").alias("t"))).alias("x"))
    line = each.groupBy("page", "class_id", "size").agg(F.transform(F.array_sort(F.flatten(F.collect_list("x"))), lambda s: s.t).alias("t"))
    in_turn = F.forall(F.transform("t", lambda t, i: F.coalesce(t == F.get("t", i - F.col("size")), F.lit(True))), lambda ok: ok)
    line = line.select("class_id", in_turn.alias("in_turn"), F.array_join(F.slice("t", F.lit(1), F.col("size")), "\t").alias("o"))
    ordered = line.groupBy("class_id").agg((F.bool_and("in_turn") & (F.min("o") == F.max("o"))).alias("ordered"))
    valid = (F.col("n_pages") >= SUPPORT) & ((size == 1) | F.coalesce("ordered", F.lit(False)))
    refined = found.join(ordered, "class_id", "left").select("dialect", "class_id", "tokens", "n_pages", valid.alias("valid"))
    forms = paged.filter("form is not null").groupBy("dialect", "form").agg(F.count_distinct("page").alias("n_pages"))
    return refined.unionByName(forms.select("dialect", F.md5(F.concat_ws(" ", "dialect", "form")).alias("class_id"), F.array("form").alias("tokens"), "n_pages", F.lit(True).alias("valid")))


def templates(paged: DataFrame) -> DataFrame:
    """The classes with parent_id: the class that all occurrences of a class lie in, null at the top or where they lie in several."""
    paged = stage(paged)
    own = stage(_grouped(_names(paged)).select("class_id", "dialect", F.explode("tokens").alias("token")))
    edges = paged.select("dialect", "token", F.explode("within").alias("holder")).distinct()
    holders = own.select(F.concat_ws("\t", "dialect", "token").alias("holder"), F.col("class_id").alias("parent"))
    nested = edges.join(own, ["dialect", "token"]).join(holders, "holder", "left").filter("parent is null or parent <> class_id")
    top = F.coalesce("parent", F.lit(""))
    nested = nested.groupBy("class_id").agg(F.min(top).alias("p"), F.max(top).alias("q"))
    return classes(paged).join(nested.select("class_id", F.when((F.col("p") == F.col("q")) & (F.col("p") != ""), F.col("p")).alias("parent_id")), "class_id", "left").select("dialect", "class_id", "tokens", "n_pages", "valid", "parent_id")


def in_template(paged: DataFrame) -> DataFrame:
    """The rows of ``pages`` whose token is in a template, as (…, name): by its own class or by that of its form.

    Loose tokens need both ends of their pair in the class.
    """
    known = classes(paged).filter("valid").select("dialect", F.explode("tokens").alias("name"), "tokens")
    first, closes = F.substring("name", 1, 1), F.substring("name", 2, 1) == "/"
    partner = F.when(closes, F.concat(first, F.expr("substring(name, 3)"))).otherwise(F.concat(first, F.lit("/"), F.expr("substring(name, 2)")))
    known = stage(known.filter((F.col("dialect") != FRAME) | F.array_contains("tokens", partner)).select("dialect", "name"))
    return paged.withColumn("name", F.explode(F.array_compact(F.array("token", "form")))).join(known, ["dialect", "name"], "left_semi")


def with_markup(paged: DataFrame, key: str) -> DataFrame:
    """(key, field) of the values with a token of a template."""
    return in_template(stage(paged)).select(key, "field").distinct()


def cleaned(vals: DataFrame, key: str) -> DataFrame:
    """(key, field, clean_text) of each value: the tokens of templates are taken out, their slots stay."""
    shape = f"`{key}` {dict(vals.dtypes)[key]}, field string, clean_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [{(d["dialect"], d["name"]) for d in x or ()} for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(clean, batch.column(2).to_pylist(), known), pa.string())], names=[key, "field", "clean_text"])

    template = in_template(stage(pages(vals, key))).groupBy("page").agg(F.collect_set(F.struct("dialect", "name")).alias("template"))
    return vals.withColumn("page", _page(key)).join(template, "page", "left").select(key, "field", "value", "template").mapInArrow(run, shape)
