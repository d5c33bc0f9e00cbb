"""Words of a text for comparisons that ignore case, layout, punctuation, added marks and citations."""

import re
import zlib
from functools import lru_cache

from scholarmill.llm.lookalike import _settled, consistent

# Marks that are no words: hyphenated line ends (joined), citations, project tokens, tags, commands, references.
JOIN = re.compile(r"-(?<=\w-)[ \t]*\n\s*(?=\w)")
MARKS = re.compile(
    r"\\(?:cite\w*|ref|label|footnotemark)\*?(?:\[[^\]]*\])*\{[^}]*\}|<\|[^|>]+\|>|</?[A-Za-z][\w:-]*(?:\s+[\w:-]+=(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*/?>|"
    r"\[\^?\d+(?:[\s,;–-]+\d+)*\]|\[\^?[\w,;\- ]{1,12}\]|\((?:[A-Z][\w.'-]*(?: (?:and|&) [A-Z][\w.'-]*| et al\.?)?,? (?:19|20)\d\d[a-z]?(?:; )?)+\)|\\[A-Za-z]+\*?|&[A-Za-z]+;"
)
SIGNS = re.compile(r"[\W_]+")


@lru_cache(maxsize=200_000)
def bare(word: str) -> str:
    """The letters and digits of a word."""
    return SIGNS.sub("", word)


def words(text: str | None) -> list[str]:
    """The words between white space, in lower case, letters and digits only; none for a null text."""
    if not text:
        return []
    if not text.isascii() and not all(map(_settled, set(text))):
        text = consistent_lines(text)
    text = MARKS.sub(" ", JOIN.sub("-", text)).lower()
    return [b for w in text.split() if (b := w if w.isalnum() else bare(w))]


def consistent_lines(text: str) -> str:
    return "\n".join(consistent(line) for line in text.split("\n"))


@lru_cache(maxsize=500_000)
def word_hash(word: str) -> int:
    """A 31-bit hash of a word, the same on every machine."""
    return zlib.crc32(word.encode()) & 0x7FFFFFFF
