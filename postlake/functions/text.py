"""Text cleaning and folding, all inside the JVM.

Spark has no Unicode ``normalize`` expression, but its own class path carries ICU (used for
collations), whose compatibility forms are reachable through ``reflect``. Rows that need them
are rare: character classes decide, and all other rows take plain expressions.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache
from html import entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake.rules.words import MISSING_MARKERS

# Characters Python's \s matches and Java's (?U)\s does not are the four file separators.
SPACES = r"(?U)[\s\x1c-\x1f]+"
_UNTIDY = r"(?U)[\s\x1c-\x1f&&[^ ]]|  "  # what SPACES would change: no plain space, or two
_LATIN_END = 0x24F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` bound once, so large expressions are not repeated.

    The value is the start of an empty array's aggregate, the body its finish. (As the only item of a
    transformed array, each row would work out the types of the whole body anew, at every level of nesting.)
    Python steps may be part of ``value`` but not of ``body`` (it becomes an array lambda).
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


def _bound(value: Column | str, body) -> Column:
    """``let`` of an expression; a column's name needs no binding, and its body is compiled."""
    return body(F.col(value)) if isinstance(value, str) else let(value, body)


def any_phrase(text: Column, phrases) -> Column:
    """True when one of ``phrases`` occurs in ``text`` (plain substring tests)."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | text.contains(phrase)
    return hit


def literal_map(table: dict) -> Column:
    """A constant map (folded once at planning) of text keys to text or whole numbers."""
    text = "\n".join(f"{k}\t{v}" for k, v in table.items())
    pairs = F.str_to_map(F.lit(text), F.lit("\n"), F.lit("\t"))
    return pairs.cast("map<string,int>") if isinstance(next(iter(table.values())), int) else pairs


def lookup(table: dict, key: Column) -> Column:
    """NULL for a missing or NULL key, also under ANSI mode."""
    return F.try_element_at(literal_map(table), key)


# --- Unicode helpers (driver side, run once: they build character classes by rule) ---------


def _folded(char: str) -> str:
    decomposed = unicodedata.normalize("NFKD", char)
    return "".join(c for c in decomposed if not unicodedata.combining(c)).casefold()


def _keeps(text: str) -> str:
    return "".join(c for c in text if c.isascii() and (c.isalnum() or c in "+#"))


def _class_of(codes: list[int]) -> str:
    """A regex character-class body covering ``codes``, as ranges."""
    parts, start, last = [], None, None
    for code in codes + [None]:
        if start is not None and (code is None or code != last + 1):
            parts.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
            start = None
        if code is not None and start is None:
            start = code
        last = code
    return "".join(parts)


@lru_cache
def _latin_pairs() -> tuple[str, str]:
    """Latin letters whose folded form is one ASCII character: JVM ``translate`` handles them."""
    source, target = [], []
    for code in range(0xC0, _LATIN_END + 1):
        folded = _folded(chr(code))
        if len(folded) == 1 and folded == _keeps(folded):
            source.append(chr(code))
            target.append(folded)
    return "".join(source), "".join(target)


# Characters ordinary Latin text is made of; anything outside gets the long class test.
_COMMON = (*range(0x80, _LATIN_END + 1), *range(0x2010, 0x2028))
_UNCOMMON = f"[^\\x{{0}}-\\x{{{_LATIN_END:X}}}\\x{{2010}}-\\x{{2027}}]"


def _beyond_ascii(text: Column) -> Column:
    """A character takes more than one byte: the cheap test in front of those on character classes."""
    return F.octet_length(text) != F.char_length(text)


def _holds(text: Column, codes: tuple[int, ...]) -> Column:
    """Does the text hold one of ``codes``? A short class decides for common characters; the
    class of all others (hundreds of ranges) runs only on texts that have such characters."""
    common = set(_COMMON)
    near = [c for c in codes if c in common]
    far = [c for c in codes if c not in common]
    return text.rlike(f"[{_class_of(near)}]") | (text.rlike(_UNCOMMON) & text.rlike(f"[{_class_of(far)}]"))


@lru_cache
def _needs_fold() -> tuple[int, ...]:
    """Characters of characters whose folding is neither ASCII, a known Latin letter, nor a blank."""
    latin = set(_latin_pairs()[0])
    codes = []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or chr(code) in latin:
            continue
        char = chr(code)
        if unicodedata.combining(char) or _keeps(_folded(char)):
            codes.append(code)
    return tuple(codes)


@lru_cache
def _combining() -> str:
    """Class of combining characters."""
    codes = [c for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c))]
    return f"[{_class_of(codes)}]"


@lru_cache
def _needs_nfkc() -> tuple[int, ...]:
    """Characters NFKC may change (NBSP is left to the whitespace rule)."""
    codes = [
        code
        for code in range(0x80, sys.maxunicode + 1)
        if not 0xD800 <= code <= 0xDFFF
        and code != 0xA0
        and (unicodedata.combining(chr(code)) or unicodedata.normalize("NFKC", chr(code)) != chr(code))
    ]
    # Hangul jamo vowels and tails compose although each alone is stable.
    return tuple(sorted(set(codes) | set(range(0x1161, 0x1200))))


# --- ICU and encodings -----------------------------------------------------------------------

_ICU = "com.ibm.icu.text.Normalizer"
# Windows-1252 printable characters and the bytes they stand for, by rule.
_CP1252 = [(bytes([b]).decode("cp1252"), chr(b)) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_PRINTED, _BYTES = ("".join(chars) for chars in zip(*_CP1252))


def _icu(method: str, text: Column) -> Column:
    return F.when(text.isNotNull(), F.reflect(F.lit(_ICU), F.lit(method), text, F.lit(True)))


def nfkc(text: Column | str) -> Column:
    return _bound(text, lambda t: F.when(_beyond_ascii(t) & _holds(t, _needs_nfkc()), _icu("compose", t)).otherwise(t))


# Named entities that HTML 5 added to those of HTML 4 or changed, from Python's table; "AMP" waits for the last step.
_HTML5 = {
    name.removesuffix(";"): value for name, value in entities.html5.items()
    if name.endswith(";") and chr(entities.name2codepoint.get(name.removesuffix(";"), 0)) != value
} | {"AMP": "&amp;"}
_HTML5_TABLE = "\x1e".join(f"{name}\x1d{value}" for name, value in _HTML5.items())


def _newer_entities(text: Column) -> Column:
    """Replace the names that only HTML 5 knows; one look-up for each name that stands in the text."""
    table = F.str_to_map(F.lit(_HTML5_TABLE), F.lit("\x1e"), F.lit("\x1d"))
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    return F.aggregate(
        names, text,
        lambda t, n: F.coalesce(F.replace(t, F.concat(F.lit("&"), n, F.lit(";")), F.try_element_at(table, n)), t))


def unescape_html(text: Column | str) -> Column:
    """HTML entities to characters: numeric ones (with the Windows-1252 reading of 128-159)
    and all named ones; a missing semicolon is tolerated on the common names."""

    def decode(t: Column) -> Column:
        newer = F.when(t.rlike("&(?!(?:amp|lt|gt|quot|nbsp);)[A-Za-z][A-Za-z0-9]*;"), _newer_entities(t)).otherwise(t)
        closed = F.regexp_replace(newer, "&(amp|lt|gt|quot|nbsp)(?![A-Za-z0-9;])", "&$1;")
        closed = F.replace(closed, F.lit("&apos;"), F.lit("&#39;"))
        plain = F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), closed)
        remapped = F.when(
            t.rlike("(?i)&#(1[2-5][0-9]|x[89][0-9a-f]);"), F.translate(plain, _BYTES, _PRINTED)
        ).otherwise(plain)
        return F.when(t.contains("&"), remapped).otherwise(t)

    return _bound(text, decode)


def repair_mojibake(text: Column | str) -> Column:
    """Undo UTF-8 that was decoded as Windows-1252, where telltale sequences are present and the
    round trip is clean."""

    def repair(t: Column) -> Column:
        single = F.translate(t, _PRINTED, _BYTES)
        back = F.try_validate_utf8(F.encode(single, "ISO-8859-1").cast("string"))
        one_byte = single.rlike("^[\\x{00}-\\x{FF}]*$") & ~t.rlike("[\\x{80}-\\x{9F}]")
        broken = t.rlike("[ÂÃ][\\x{80}-¿]|â€")
        return F.when(_beyond_ascii(t) & broken & one_byte, F.coalesce(back, t)).otherwise(t)

    return _bound(text, repair)


# --- column functions ----------------------------------------------------------------------


def tidy(text: Column | str) -> Column:
    """Whitespace runs become one space, ends trimmed, 'no value' words become NULL."""
    return let(
        _bound(text, lambda t: F.trim(F.when(t.rlike(_UNTIDY), F.regexp_replace(t, SPACES, " ")).otherwise(t))),
        lambda t: F.when(~F.lower(t).isin(*MISSING_MARKERS), t),
    )


def clean_text(value: Column | str) -> Column:
    """Tidy single-line text in NFKC form, or NULL when it carries no information."""
    return tidy(nfkc(as_column(value).cast("string")))


def fold_accents(value: Column | str) -> Column:
    """Accent-free, lower-case text with punctuation kept ('' for NULL)."""
    source, target = _latin_pairs()

    def fold(t: Column) -> Column:
        bare = F.regexp_replace(_icu("decompose", t), _combining(), "")
        special = F.replace(F.lower(F.replace(bare, F.lit("ẞ"), F.lit("ss"))), F.lit("ß"), F.lit("ss"))
        near = F.when(_holds(t, _needs_fold()), special).otherwise(F.lower(F.translate(t, source, target)))
        return F.when(_beyond_ascii(t), near).otherwise(F.lower(t))

    return let(F.coalesce(as_column(value), F.lit("")), fold)


def squeeze(folded: Column) -> Column:
    """Folded text reduced to words of ``0-9a-z+#`` with single spaces."""
    return F.trim(F.regexp_replace(folded, "[^0-9a-z+#]+", " "))


def normalize_for_matching(value: Column | str) -> Column:
    """Lower-case, accent- and punctuation-free form for keys; '+' and '#' survive."""
    return squeeze(fold_accents(value))


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), SPACES, " "))


def description_text(raw: Column | str) -> Column:
    """Plain text of an HTML description, entities decoded twice; NULL when nothing is left."""
    return F.nullif(strip_tags(unescape_html(unescape_html(raw))), F.lit(""))
