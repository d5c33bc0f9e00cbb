"""One consistent form of texts that look the same but consist of other characters.

Each token's characters have script sets; their intersection is the token's resolved script set. A token without one
mixes scripts: it takes the spelling in the one script that has a look-alike for each of its letters. A token of one
script that could be spelled whole in the script of the text around it takes that spelling. What is left is brought to
plain forms: full-width letters, ligatures, spaces, composed accents, no invisible characters.
"""

import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin letters and the letters of other scripts that are drawn alike.
LATIN_CYRILLIC = "aа cс dԁ eе hһ iі jј oо pр qԛ sѕ wԝ xх yу AА BВ CС EЕ GԌ HН IІ JЈ KК MМ OО PР QԚ SЅ TТ WԜ XХ YҮ"
LATIN_GREEK = "aα iι oο vν uυ pρ AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ"
LATIN_ARMENIAN = "gց hհ jյ nո oօ qզ uս LԼ OՕ SՏ UՍ"
LATIN_CHEROKEE = "AᎪ BᏴ CᏟ DᎠ EᎬ GᏀ HᎻ JᎫ KᏦ LᏞ MᎷ PᏢ RᎡ SᏚ TᎢ VᏙ WᎳ ZᏃ"
SAME_SCRIPT = {"ɡ": "g", "ɑ": "a", "ı": "i", "‐": "-", "‑": "-", "ƽ": "s", "ꞌ": "'"}
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Georgian", "Hebrew", "Arabic", "Devanagari", "Thai", "Han", "Hiragana", "Katakana", "Hangul", "Bopomofo", "Cherokee")
#: Kinds of compatibility forms that read as the plain ones; raised, lowered, circled and the like look different.
PLAIN_FORMS = ("<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<isolated>", "<initial>", "<medial>", "<final>")


SPELLED = {"Cyrillic": LATIN_CYRILLIC, "Greek": LATIN_GREEK, "Armenian": LATIN_ARMENIAN, "Cherokee": LATIN_CHEROKEE}


def _pairs() -> dict[tuple[str, str], dict[str, str]]:
    """For two scripts, the letters of the first by those of the second; through Latin where neither is."""
    out: dict[tuple[str, str], dict[str, str]] = {}
    for other, pairs in SPELLED.items():
        out[other, "Latin"] = {p[1]: p[0] for p in pairs.split()}
        out["Latin", other] = {p[0]: p[1] for p in pairs.split()}
    for a in SPELLED:
        for b in SPELLED:
            if a != b:
                out[a, b] = {x: out["Latin", b][y] for x, y in out[a, "Latin"].items() if y in out["Latin", b]}
    # letters drawn alike in one direction only
    out["Cyrillic", "Latin"]["У"] = "Y"
    return out


ALIKE = _pairs()


@cache
def scripts(ch: str) -> frozenset[str] | None:
    """The scripts that ``ch`` belongs to; None for characters common to all."""
    import regex

    if not unicodedata.category(ch).startswith("L"):
        return None
    return frozenset(s for s in SCRIPTS if regex.match(rf"\p{{scx={s}}}", ch)) or frozenset(["other"])


@lru_cache(maxsize=200_000)
def resolved(token: str) -> frozenset[str] | None:
    """The intersection of the script sets of the token's letters: None without letters, empty for a mixed token."""
    sets = [s for s in map(scripts, token) if s is not None]
    return frozenset.intersection(*sets) if sets else None


def spelled(token: str, script: str) -> str | None:
    """The token in ``script``, if each of its letters is of that script or has a look-alike there."""
    out = []
    for ch in token:
        of = scripts(ch)
        if of is None or script in of:
            out.append(ch)
            continue
        for s in of:
            if ch in ALIKE.get((s, script), ()):
                out.append(ALIKE[s, script][ch])
                break
        else:
            return None
    return "".join(out)


@cache
def _plain(ch: str) -> str:
    kind = unicodedata.category(ch)
    if ch in SAME_SCRIPT:
        return SAME_SCRIPT[ch]
    if kind == "Cf" or ch in "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" or "︀" <= ch <= "️":
        return ""
    if kind in ("Zs", "Zl", "Zp"):
        return " "
    form = unicodedata.decomposition(ch)
    if form.startswith(PLAIN_FORMS):
        return "".join(map(_plain, unicodedata.normalize("NFKC", ch)))
    return ch


@cache
def _settled(ch: str) -> bool:
    """Whether ``ch`` is a plain Latin letter or a sign that stays as it is."""
    return _plain(ch) == ch and scripts(ch) in (None, frozenset(["Latin"])) and not unicodedata.combining(ch)


@cache
def _telling(ch: str) -> str | None:
    """The one script of a letter that has no look-alike in another."""
    s = scripts(ch)
    if s is None or len(s) != 1 or any(ch in ALIKE.get((*s, o), ()) for o in ("Latin", *SPELLED)):
        return None
    return next(iter(s))


def consistent(text: str | None) -> str | None:
    """The consistent form of ``text``: texts that look the same have the same one. Null stays null.

    Letter case, punctuation and accents are kept; runs of white space become one space and none is left at the ends.
    """
    if text is None:
        return None
    if text.isascii() or all(map(_settled, set(text))):
        return " ".join(text.split())
    text = unicodedata.normalize("NFC", "".join(map(_plain, text)))
    text = " ".join(text.split())
    if text.isascii():
        return text
    clear: dict[str, int] = {}  # letters without look-alikes tell the script of the text
    out: list[str | tuple[str, ...]] = []
    for token in _tokens(text):
        of = resolved(token)
        if of is not None and "Latin" not in of or token.isascii():
            for s in map(_telling, token):
                if s is not None:
                    clear[s] = clear.get(s, 0) + 1
        out.append(token)
    main = max(clear, key=lambda s: (clear[s], s == "Latin"), default="Latin")
    for k, token in enumerate(out):
        of = None if token.isascii() and main == "Latin" else resolved(token)
        if of is None or main in of:
            continue
        new = spelled(token, main)
        if new is None and not of:
            new = next((x for s in ("Latin", *SPELLED) if (x := spelled(token, s)) is not None), None)
        if new is not None:
            out[k] = new
    return "".join(out)


@cache
def _token_pattern():
    import regex

    return regex.compile(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+")


def _tokens(text: str) -> list[str]:
    return _token_pattern().findall(text)


def with_consistent(df: DataFrame, text: str, out: str = "consistent_form") -> DataFrame:
    """``df`` with the consistent form of the column ``text``."""
    names, at = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(consistent, batch.column(at).to_pylist()), pa.string())], names=[*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def forms(df: DataFrame, key: str, text: str, field: str) -> DataFrame:
    """(field, id, form, raw): 128-bit hashes of the consistent form and of the text itself; null and blank texts have none."""
    df = with_consistent(df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("_text")), "_text")
    twice = lambda c: F.struct(F.xxhash64(c).alias("a"), F.xxhash64(F.lit("second"), c).alias("b"))
    return df.filter("consistent_form <> ''").select(F.lit(field).alias("field"), "id", twice("consistent_form").alias("form"), twice("_text").alias("raw"))


def same_look(left: DataFrame, right: DataFrame) -> DataFrame:
    """(field, left_id, right_id): the pairs of rows that look the same though their strings differ, each once.

    Spellings are paired first, once each however many rows have them, so equal strings and spellings without a partner
    are never expanded; then the ids of the spellings that have a partner are joined to those pairs.
    """
    a, b = (x.select("field", "form", "raw").distinct() for x in (left, right))
    pairs = a.join(b.withColumnRenamed("raw", "raw2"), ["field", "form"]).filter("raw <> raw2")
    out = pairs.join(left.distinct().withColumnRenamed("id", "left_id"), ["field", "form", "raw"])
    out = out.join(right.distinct().withColumnsRenamed({"id": "right_id", "raw": "raw2"}), ["field", "form", "raw2"])
    return out.select("field", "left_id", "right_id").distinct()
