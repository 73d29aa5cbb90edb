"""Diacritic stripping and Latin transliteration."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmesh.functions.columns import column

#: Characters that lump together with an ASCII one, after decomposition; fixed values.
LUMPS = {
    "'": "‘’ʼˈ",
    "-": "−",
    "/": "⁄∕",
    ":": "∶",
    "<": "‹〈〈",
    ">": "›〉〉",
    "\\": "∖",
    "^": "˄ˆ‸⌃",
    "_": "ˍ",
    "`": "ˋ",
    "|": "∣",
    "~": "∼",
}
_CATEGORY_LUMPS = {"Zs": " ", "Pd": "-", "Pc": "_"}
#: Letters without a decomposition; fixed values. First one to one, then one to two.
ONE = ("ØøÐðŁłĐđ", "OoDdLlDd")
TWO = {"Þ": "Th", "þ": "th", "ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}
_LATIN = f"[{ONE[0]}{''.join(TWO)}]"


def _ranges(points: list[int]) -> str:
    """A class of a regular expression that has these code points."""
    starts = [p for p, q in zip(points, [-2, *points], strict=False) if p != q + 1]
    ends = [p for p, q in zip(points, [*points[1:], -2], strict=True) if q != p + 1]
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in zip(starts, ends, strict=True)) + "]"


def _marks() -> str:
    """All marks: those that the Java machine knows, and those that it takes for unassigned as they are newer than it."""
    return r"\p{M}|(?=\p{Cn})" + _ranges([i for i in range(0x110000) if unicodedata.category(chr(i))[0] == "M"])


def _lumped() -> tuple[str, str]:
    """Characters that become another one, and these, by category and by the table above."""
    pairs = {c: to for to, own in LUMPS.items() for c in own}
    for i in range(0x80, 0x110000):
        to = _CATEGORY_LUMPS.get(unicodedata.category(chr(i)))
        if to:
            pairs.setdefault(chr(i), to)
    return "".join(pairs), "".join(pairs.values())


#: The marks of Latin, Greek and Cyrillic, which are all that most texts have; other scripts, and their marks.
LATIN_MARKS, OTHER_SCRIPTS, MARKS = r"[\x{300}-\x{36f}]+", r"[^\x00-\x{2ff}]", _marks()
LUMPED = _lumped()
#: Non-ASCII characters that lump; one test passes over ASCII ones.
_LUMP_CLASS = r"(?=[^\x00-\x7f])" + _ranges(sorted({ord(c) for c in LUMPED[0]}))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def strip_diacritics(text: Column | str) -> Column:
    """Compatibility decomposition without marks, punctuation variants as ASCII; not recomposed.

    Letters without a decomposition (such as Ø, ß, Ł) stay. The text ends at a NUL character. The decomposition
    is that of the Unicode library which Spark itself uses; texts of ASCII characters alone are left as they are.
    """
    text = column(text)
    begun = F.substring_index(text, "\0", 1)
    whole = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(begun, F.lit("")), F.lit(True))
    latin = F.regexp_replace(whole, LATIN_MARKS, "")
    bare = _once(latin, lambda x: F.when(x.rlike(OTHER_SCRIPTS), F.regexp_replace(x, MARKS, "")).otherwise(x))
    lumped = _once(bare, lambda x: F.when(x.rlike(_LUMP_CLASS), F.translate(x, *LUMPED)).otherwise(x))
    return F.when(text.isNull() | (F.octet_length(begun) == F.char_length(begun)), begun).otherwise(lumped)


def sql_strip_diacritics(text: str) -> str:
    """The same in SQL."""

    def literal(value: str) -> str:
        return "'" + "".join(f"\\U{ord(c):08x}" if ord(c) > 126 or c in "'\\" else c for c in value) + "'"

    begun = f"substring_index({text}, '\\0', 1)"
    latin = f"regexp_replace(java_method('com.ibm.icu.text.Normalizer', 'decompose', coalesce({begun}, ''), true), {literal(LATIN_MARKS)}, '')"
    bare = f"transform(array({latin}), x -> CASE WHEN x RLIKE {literal(OTHER_SCRIPTS)} THEN regexp_replace(x, {literal(MARKS)}, '') ELSE x END)"
    lumped = f"transform({bare}, x -> CASE WHEN x RLIKE {literal(_LUMP_CLASS)} THEN translate(x, {literal(LUMPED[0])}, {literal(LUMPED[1])}) ELSE x END)[0]"
    return f"CASE WHEN {text} IS NULL OR octet_length({begun}) = char_length({begun}) THEN {begun} ELSE {lumped} END"


def unaccent(text: Column | str) -> Column:
    """:func:`strip_diacritics`, then Latin letters without a decomposition as ASCII letters."""

    def spelled(x: Column) -> Column:
        out = F.translate(x, *ONE)
        for letter, pair in TWO.items():
            out = F.replace(out, F.lit(letter), F.lit(pair))
        return out

    return _once(strip_diacritics(text), lambda x: F.when(x.rlike(_LATIN), spelled(x)).otherwise(x))


def sql_unaccent(text: str) -> str:
    """The same in SQL, after ``strip_diacritics``."""
    out = f"translate(x, '{ONE[0]}', '{ONE[1]}')"
    for letter, pair in TWO.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    return f"transform(array(strip_diacritics({text})), x -> CASE WHEN x RLIKE '{_LATIN}' THEN {out} ELSE x END)[0]"
