"""Bibliographies: items of .bbl and .bib files, keys, titles, fields, and BibTeX entries made from metadata."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarmill.functions.latex import first_match


def bbl_items(c: Column) -> Column:
    r"""Items from \bibitem to the next or the end of the bibliography, lines trimmed; null gives null."""
    body = F.regexp_replace(c, r"(?s)\\end\{thebibliography\}.*", "")
    items = F.regexp_extract_all(body, F.lit(r"(?s)(\\bibitem(?:(?!\\bibitem).)*)"), 1)
    lines = lambda x: F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(s)), lambda s: s != ""), "\n")
    return F.transform(items, lines)


def split_bib(text: str | None) -> list[str]:
    """Entries from an @ at a line's start to the brace that closes it, blank and comment lines skipped.

    An entry on one line is closed by its own line, though the written rule lets it take the next line in.
    """
    out: list[str] = []
    lines: list[str] = []
    depth = 0
    for line in (text or "").split("\n"):
        line = line.strip()
        if not line or line.startswith("%"):
            continue
        if line.startswith("@"):
            if lines:
                out.append("\n".join(lines))
            lines, depth = [], 0
        elif not lines:
            continue
        lines.append(line)
        depth += line.count("{") - line.count("}")
        if depth <= 0 and "{" in "".join(lines):
            out.append("\n".join(lines))
            lines, depth = [], 0
    return out + (["\n".join(lines)] if lines else [])


@F.pandas_udf(T.ArrayType(T.StringType()))
def bib_entries(texts: pd.Series) -> pd.Series:
    """The entries of each .bib text."""
    return texts.map(split_bib)


def formal_entries(c: Column) -> Column:
    """Entries by one pattern, for texts without a further @ inside an entry."""
    return F.regexp_extract_all(c, F.lit(r"(@\w+\s*\{[^@]*\})"), 1)


def entry_key(c: Column) -> Column:
    """The key of an entry, null where there is none."""
    return F.trim(first_match(c, r"@\w+\s*\{([^,]+),"))


def entry_title(c: Column, whole_word: bool = True) -> Column:
    """The title of an entry up to its first brace or quote; without ``whole_word`` a booktitle before it counts too."""
    start = r"(?:^|[^A-Za-z])" if whole_word else ""
    return F.trim(first_match(c, rf"(?is){start}title\s*=\s*[{{\"]+([^}}\"]+)[}}\"]"))


def bibitem_key(c: Column) -> Column:
    r"""The key of a \bibitem with any label, of its declaring forms, else of an entry that has a title."""
    flat = F.regexp_replace(F.regexp_replace(c, r"%\s*\n\s*", ""), r"\s+", " ")
    found = first_match(flat, r"\\bibitem\s*(?:\[(?:[^\[\]]|\{[^{}]*\})*\])?\s*\{([^}]+)\}", r"\\bibitemdeclare\s*\{[^}]*\}\s*\{([^}]+)\}", r"\\bibitemstart\s*\{([^}]+)\}")
    return F.trim(F.coalesce(found, F.when(entry_title(flat).isNotNull(), entry_key(flat))))


def entry_fields(c: Column) -> Column:
    """(type, key, fields): lower-case field names; of a repeated field the last counts."""
    name = F.regexp_extract_all(c, F.lit(r"(\w+)\s*=\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"), 1)
    value = F.regexp_extract_all(c, F.lit(r"\w+\s*=\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"), 1)
    pairs = F.transform(F.arrays_zip(name.alias("k"), value.alias("v")), lambda p, i: F.struct(F.lower(p["k"]).alias("k"), p["v"].alias("v"), i.alias("i")))
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    return F.struct(
        F.lower(first_match(c, r"@(\w+)\s*\{")).alias("type"), entry_key(c).alias("key"), F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"]))).alias("fields")
    )


def item_title(text: str | None) -> str | None:
    r"""The title of a \bibitem: marked article title, second block, emphasised part of a block, quoted, emphasised, after a colon."""
    if not text:
        return None
    t = re.sub(r"\s+", " ", text)
    body = re.sub(r"\\bibitem\s*(?:\[(?:[^\[\]]|\{[^{}]*\})*\])?\s*\{[^}]*\}", "", t)
    for pattern in (r"\\showarticletitle\{([^}]+)\}", r"\\newblock\s*\\(?:em|emph)\{?\s*([^}\\]+)", r"\\newblock\s*([^\\]+?)[.,]?\s*(?:\\newblock|$)", r"[“\"`]{1,2}([^”\"']+?)[,.]?(?:”|\"|'')", r"\\emph\{([^}]+)\}", r"\{\\em\s+([^}]+)\}", r":\s*([^.]+)\."):
        for m in re.finditer(pattern, body):
            found = re.sub(r"[{}]", "", m[1]).strip(" .,")
            if len(found) > 2 and not re.match(r"(?:in |proceedings|springer|ieee|acm|arxiv|journal)", found, re.I):
                return found
    return None


@F.pandas_udf(T.StringType())
def bibitem_as_entry(items: pd.Series) -> pd.Series:
    r"""A \bibitem as a @misc entry with its key and title; null where it has no key, "Unknown" where no title is found."""

    def one(t: str | None) -> str | None:
        key = re.search(r"\\bibitem\s*(?:\[(?:[^\[\]]|\{[^{}]*\})*\])?\s*\{([^}]+)\}", t or "")
        return f"@misc{{{key[1].strip()},\n  title={{{item_title(t) or 'Unknown'}}}\n}}" if key else None

    return items.map(one)


def version_year(created: Column) -> Column:
    """The year of an RFC 822 date, by position."""
    return F.get(F.split(F.trim(F.get(F.split(created, ","), 1)), " "), 2)


def journal_year(ref: Column) -> Column:
    """What follows the last comma of a journal reference with a colon."""
    return F.when(F.contains(ref, F.lit(":")), F.trim(F.element_at(F.split(ref, ","), -1)))


def bibtex(id_: Column, title: Column, authors: Column, last_name: Column, created: Column, journal_ref: Column, doi: Column, report_no: Column, categories: Column) -> Column:
    """(bibtex, citation_key): an article entry from metadata.

    The key is last name, year and first title word; without a year last name and _arxiv. A row without a title or a
    name gets the minimal entry keyed by its id.
    """
    year = F.coalesce(version_year(created), journal_year(journal_ref))
    bare = lambda c: F.replace(c, F.lit("\\"), F.lit(""))
    name = F.lower(bare(F.coalesce(last_name, F.element_at(F.split(F.trim(F.get(F.split(authors, ","), F.lit(0))), r"\s+"), -1))))
    key = F.when(year.isNull(), F.concat(name, F.lit("_arxiv"))).otherwise(F.concat(name, year, F.get(F.split(F.lower(F.trim(title)), " "), F.lit(0))))
    field = lambda n, v: F.when(F.length(v) > 0, F.concat(F.lit(f"    {n}={{"), v, F.lit("}")))
    journal = F.when(F.length(journal_ref) > 0, journal_ref).otherwise(F.concat(F.lit("arXiv preprint arXiv:"), id_))
    body = F.concat_ws(",\n", field("title", F.trim(title)), field("author", bare(authors)), field("journal", journal), field("year", year), field("doi", doi), field("number", report_no), F.lit("    archivePrefix={arXiv}"), field("eprint", id_), field("primaryClass", categories))
    full = F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}"))
    least = F.concat(F.lit("@article{"), id_, F.lit(",\n    title={"), F.coalesce(title, F.lit("Unknown Title")), F.lit("},\n    journal={arXiv preprint arXiv:"), id_, F.lit("},\n    author={"), F.coalesce(authors, F.lit("Unknown Authors")), F.lit("}\n}"))
    return F.struct(F.coalesce(full, least).alias("bibtex"), F.coalesce(key, id_).alias("citation_key"))
