"""Text columns: sentences, words, markup, whitespace. All of it runs inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE = r"[^.!?\n]+[.!?]*"
# A word is a run of letters of any alphabet.
WORD = CASED_WORD = r"\p{L}+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Compute a value once per row and use it several times within one expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_sentences(text: Column) -> Column:
    """Sentences of a text in order, as an array; blank pieces are dropped."""
    pieces = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(pieces, lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    """Lower-cased words in order, repetitions kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct lower-cased words, longest first, ties alphabetical.

    Long words are the rare ones, so this fixed order serves as the rarity order of the
    similarity join without counting the corpus first.
    """
    keyed = F.transform(
        F.array_distinct(words(text)),
        lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")),
    )
    return F.transform(F.sort_array(keyed), lambda s: s["w"])


# Letters with accents and the letters they stand for; letters that stand for two.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
BASE_LETTERS = "aaaaaaceeeeiiiinoooooouuuuyy"
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe"}


def plain_form(text: Column) -> Column:
    """Lower-cased text reduced to ``[a-z0-9 ]``, accented letters to their base: the form edit distances are taken on."""
    folded = F.translate(F.lower(text), ACCENTED, BASE_LETTERS)
    folded = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), folded)
    return F.regexp_replace(folded, "[^a-z0-9 ]", "")


def strip_whitespace(text: Column) -> Column:
    """Drop any white space (not only blanks) at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def clean_whitespace(text: Column) -> Column:
    """Line breaks and tabs become blanks, runs of blanks become one."""
    return F.regexp_replace(F.regexp_replace(text, r"[\n\t\r]", " "), " +", " ")


def capitalize_first(text: Column) -> Column:
    """Upper-case the first character and leave the rest alone."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


# Control characters a spreadsheet refuses (tab, line feed and carriage return are allowed).
ILLEGAL_CONTROL_CODES = [*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20)]


def escape_control_chars(text: Column) -> Column:
    r"""Write each control character that spreadsheets refuse as a literal ``\xNN``.

    Texts without any, nearly all, are only searched.
    """
    pairs = F.array(*[F.struct(F.lit(chr(c)).alias("raw"), F.lit(f"\\x{c:02x}").alias("shown")) for c in ILLEGAL_CONTROL_CODES])
    escaped = F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["raw"], p["shown"]))
    return F.when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), escaped).otherwise(text)


def escape_all_strings(df: DataFrame) -> DataFrame:
    """Apply :func:`escape_control_chars` to every string column of a frame."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({n: escape_control_chars(F.col(f"`{n}`")) for n in names})


# A character reference: decimal, hexadecimal or by name.
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

BLOCK_END = r"(?i)</(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title)\s*>|<br\s*/?>"


def decode_references(text: Column) -> Column:
    """Decode character references from left to right, each once; unknown ones stay as they are.

    Names are those of the public table of HTML 4, and ``apos``.
    """
    names = F.create_map(*[F.lit(x) for n, c in sorted({**name2codepoint, "apos": 39}.items()) for x in (n, chr(c))])

    def char(ref: Column) -> Column:
        body = F.substr(ref, F.lit(2), F.length(ref) - 2)
        digits = F.regexp_replace(body, "^#[xX]?", "")
        code = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("int")
        fits = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        decoded = F.when(fits, F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code)), 8, "0")), "UTF-32"))
        return F.coalesce(F.when(body.startswith("#"), decoded).otherwise(F.try_element_at(names, body)), ref)

    chars = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), char)
    pieces = F.zip_with(F.split(text, REFERENCE, -1), chars, lambda g, c: F.concat(g, F.coalesce(c, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def strip_html(html: Column, separator: str = "\n") -> Column:
    """Text of an HTML fragment: no tags, no script or style content, entities decoded.

    ``separator`` is put where a block element ends. The empty string glues neighbouring
    paragraphs together and so hides sentence ends.
    """
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    if separator:
        text = F.regexp_replace(text, BLOCK_END, separator)
    text = F.regexp_replace(text, r"</?[A-Za-z!?][^>]*>", "")
    return decode_references(text)
