"""Title and id normalisation as column functions. A null gives null in all of them."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_title(c: Column) -> Column:
    """Lower case, ASCII letters and digits with single spaces: the key of exact title matching."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " +", " "))


def display_title(c: Column) -> Column:
    """White space as single spaces, no braces and full stops; ends are kept."""
    c = F.regexp_replace(c, r"[\s\x00-\x20\x7f\u00a0]", " ")
    return F.regexp_replace(F.translate(c, "{}.", ""), " {2,}", " ")


# What a title loses before it is a join key, in this order.
DROPPED = [r"\textit{", r"\textbf{", r"\emph{", r"\em{", r"\it{", r"\bf{", r"\sc{", r"\sf{", r"\rm{", r"\tiny{", r"\scriptsize{", r"\footnotesize{", r"\small{", r"\normalsize{", r"\large{", r"\Large{", r"\LARGE{", r"\huge{", r"\Huge{", r"\uppercase{", r"\lowercase{", "}"]
REPLACED = {"\\\\": " ", r"\&": "&", r"\%": "%", r"\$": "$", r"\#": "#", r"\_": "_", r"\{": "{", r"\~": "~", r"\^": "^", "``": '"', "''": '"'}


def join_title(c: Column) -> Column:
    """The key by which cited titles meet the corpus: LaTeX removed, white space single, basic punctuation kept, lower case."""
    c = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), DROPPED, c)
    c = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), REPLACED.items(), c)
    c = F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    c = F.regexp_replace(c, "(?U)[^\\w\\s\\-.,;:!?&()\\[\\]\"'/$]", "")
    return F.lower(F.trim(c))


def citation_key(c: Column) -> Column:
    """A key without white space and commas, and without colons at its ends."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), "^:+|:+$", ""), r"(?U)[,\s]", "")


def yymm(arxiv_id: Column) -> Column:
    """The month prefix of an id."""
    return F.substring(arxiv_id, 1, 4)


def byte_size(n: Column) -> Column:
    """A number of bytes as B, KB, MB or GB, whole units, rounded down."""
    unit = lambda k, name: F.concat(F.floor(n / (1 << k)).cast("string"), F.lit(name))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(10, " KB")).when(n < 1 << 30, unit(20, " MB")).otherwise(unit(30, " GB"))


def citation_label(key: Column, url: Column, longest: int = 110, cut: int = 105, width: int = 150) -> Column:
    """A key, cut to ``cut`` characters where it has more than ``longest``, padded so that it and the address fill ``width``."""
    short = F.when(F.length(key) > longest, F.concat(F.substring(key, 1, cut), F.lit("...  "))).otherwise(key)
    used = F.least(F.length(key), F.lit(longest))
    return F.concat(short, F.repeat(F.lit(" "), F.greatest(F.lit(0), width - used - F.length(url))), url)
