"""Phonetic codes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.functions.columns import column

#: Soundex digit of each letter from A to Z; fixed values.
SOUNDEX_DIGITS = "01230120022455012623010202"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def soundex(text: Column | str) -> Column:
    """Four-character Soundex of the ASCII letters of a text, in which H, W and vowels part equal digits.

    A text without letters has code 0000; what follows a NUL character is ignored.
    """
    letters = F.upper(F.regexp_replace(F.substring_index(column(text), "\0", 1), "[^A-Za-z]", ""))
    digits = F.regexp_replace(F.translate(letters, LETTERS, SOUNDEX_DIGITS), "([0-9])\\1+", "$1")
    tail = F.replace(F.substring(digits, 2, 1_000_000_000), F.lit("0"), F.lit(""))
    return F.when(letters == "", "0000").otherwise(F.rpad(F.concat(F.substring(letters, 1, 1), F.substring(tail, 1, 3)), 4, "0"))


class Way(NamedTuple):
    """One way to meet a pattern: bytes that must stand at places around, stretches that must not, and the bytes read."""

    needs: tuple[tuple[int, np.ndarray], ...] = ()
    bans: tuple[tuple[tuple[int, np.ndarray], ...], ...] = ()
    size: int = 0

    def then(self, other: Way, by: int = 0) -> Way:
        at = self.size + by

        def moved(needs):
            return tuple((place + at, allowed) for place, allowed in needs)

        return Way(self.needs + moved(other.needs), self.bans + tuple(map(moved, other.bans)), self.size + other.size)


#: Stands before and after every word; no word has it.
EDGE = 10
_PIECE = re.compile(r"\[(?P<no>\^)?(?P<any>[^]]+)\]|\((?P<group>\?<=|\?<!|\?=|\?!|\?:)|(?P<edge>\\[AZ])|\\x(?P<hex>..)|(?P<plain>[^()|?\[\\])")


def ways(pattern: str) -> tuple[Way, ...]:
    """All ways to meet a pattern, in the order in which they are tried.

    Patterns have bytes, classes, dots, groups with alternatives, the sign ``?`` and looks to both sides, as in regular expressions.
    """

    def bytes_of(found: re.Match[str]) -> np.ndarray:
        allowed = np.zeros(256, bool)
        listed = re.sub(r"\\x(..)", lambda m: chr(int(m[1], 16)), found["any"] or "").encode("latin-1")
        if found["edge"]:
            allowed[EDGE] = True
        elif found["plain"] == "." or found["no"]:
            allowed[:] = True
            allowed[[EDGE, *listed]] = False
        else:
            allowed[list(listed or (chr(int(found["hex"], 16)) if found["hex"] else found["plain"]).encode("latin-1"))] = True
        return allowed

    def alternatives(at: int) -> tuple[list[Way], int]:
        out, current = [], [Way()]
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                out, current, at = out + current, [Way()], at + 1
                continue
            found = _PIECE.match(pattern, at)
            at = found.end()
            if found["group"]:
                inner, at = alternatives(at)
                at += 1
                look = found["group"][1:]
                back = [-w.size if look[0] == "<" else 0 for w in inner]
                if look == ":":
                    items = inner
                elif look[-1] == "=":
                    items = [Way().then(w, b)._replace(size=0) for w, b in zip(inner, back, strict=True)]
                else:
                    items = [Way(bans=tuple(Way().then(w, b).needs for w, b in zip(inner, back, strict=True)))]
            else:
                edge = found["edge"]
                items = [Way(((-1 if edge == "\\A" else 0, bytes_of(found)),), (), 0 if edge else 1)]
            if pattern[at : at + 1] == "?":
                items, at = [*items, Way()], at + 1
            current = [w.then(item) for w in current for item in items]
        return out + current, at

    return tuple(alternatives(0)[0])


@dataclass(frozen=True)
class Rule:
    """What is read at a place of a word, and the codes that it adds.

    The pattern consumes what it reads; what stands around it is looked at only. ``when`` and
    ``unless`` name properties of the whole word.
    """

    ways: tuple[Way, ...]
    primary: bytes
    alternate: bytes
    when: str = ""
    unless: str = ""


def rules(*lines: tuple[str, ...]) -> tuple[Rule, ...]:
    """Lines of (pattern, primary[, alternate[, condition]]); condition ``x`` or ``not x``; V: a vowel."""
    out = []
    for pattern, primary, *more in lines:
        alternate, condition = [*more, primary, ""][:2] if more else (primary, "")
        if len(more) == 1:
            condition = ""
        no = condition.startswith("not ")
        out.append(Rule(ways(pattern.replace("V", "[AEIOUY]")), primary.encode(), alternate.encode(), "" if no else condition, condition[4:] if no else ""))
    return tuple(out)


#: Double Metaphone, by letter; the first rule that fits is taken. Fixed values.
METAPHONE = {
    **{v: rules((r"\AV", "A"), ("V", "")) for v in "AEIOUY"},
    "B": rules(("BB?", "P")),
    "\xc7": rules(("\xc7", "S")),
    "C": rules(
        (r"CH(?=IA)|(?<=[^AEIOUY]A)CH(?![IE])|(?<=[BM]A)CH(?=ER)", "K"), (r"\ACA(?=ESAR)", "S"), (r"(?<=.)CH(?=AE)", "K", "X"), (r"\ACH(?=ARAC|ARIS|OR(?!E)|YM|IA|EM)", "K"), (r"CH", "K", "K", "sch"),
        (r"(?<=OR)CH(?=ES|ID)|(?<=AR)CH(?=IT)|CH(?=[TS])", "K"), (r"(?:(?<=[AOUE])|\A)CH(?=[LRNMBHFW\x56]|\Z)", "K"), (r"(?<=.)CH", "K", "K", "mc"), (r"(?<=.)CH", "X", "K"), (r"CH", "X"),
        (r"(?<!WI)CZ", "S", "X"), (r"CCI(?=A)", "X"), (r"(?<=\AA)CC(?:[IE]|H(?!U))|(?<=U)CCE(?=[ES])", "KS"), (r"(?<!\AM)CC(?:[IE]|H(?!U))", "X"), (r"(?<!\AM)CC", "K"), (r"C[KGQ]", "K"),
        (r"CI(?=[OEA])", "S", "X"), (r"C[IEY]", "S"), (r"CC(?![EI])", "K"), (r"C", "K"),
    ),
    "D": rules((r"DG[IEY]", "J"), (r"DG", "TK"), (r"D[TD]?", "T")),
    "F": rules((r"FF?", "F")),
    "G": rules(
        (r"(?<=[^AEIOUY])GH", "K"), (r"\AGH(?=I)", "J"), (r"\AGH", "K"), (r"(?:(?<=[BHD].)|(?<=[BHD]..)|(?<=[BH]...))GH", ""), (r"(?<=[CGLRT].U)GH", "F"), (r"(?<!I)GH", "K"), (r"GH", ""),
        (r"(?<=\AV)GN", "KN", "N", "not slavo"), (r"GN(?!EY)", "N", "KN", "not slavo"), (r"GN", "KN"), (r"GL(?=I)", "KL", "L", "not slavo"), (r"\AG(?:Y|E(?=[SPBLYIR])|I(?=[BLNE]))", "K", "J"),
        (r"(?<![EI])GE(?=R)|(?<![EIRO])GY", "K", "J", "not anger"), (r"G[EIY]|(?<=[AO])GG(?=I)", "K", "K", "sch"), (r"GE(?=T)", "K"), (r"GI(?=ER)", "J"), (r"G[EIY]|(?<=[AO])GG(?=I)", "J", "K"), (r"GG?", "K"),
    ),
    "H": rules((r"(?:\A|(?<=V))HV", "H"), (r"H", "")),
    "J": rules((r"J(?=OSE)", "J", "H"), (r"\AJJ?", "J", "A"), (r"(?<=V)J(?=[AO])", "J", "H", "not slavo"), (r"J\Z", "J", " "), (r"(?<![SKL])J(?![LTKSNMBZ])J?", "J"), (r"JJ?", "")),
    "K": rules((r"KK?", "K")),
    "L": rules((r"(?<=I)LL(?=[OA]\Z)|(?<=A)LL(?=E\Z)", "L", ""), (r"(?<=A)LL(?=E)", "L", "", "ends"), (r"LL?", "L")),
    "M": rules((r"MM|(?<=U)MB(?=ER|\Z)|M", "M")),
    "N": rules((r"NN?", "N")),
    "\xd1": rules(("\xd1", "N")),
    "P": rules((r"PH", "F"), (r"P[PB]?", "P")),
    "Q": rules((r"QQ?", "K")),
    "R": rules((r"(?<=IE)(?<!M[EA]IE)R\Z", "", "R", "not slavo"), (r"RR?", "R")),
    "S": rules(
        (r"(?<=[IY])S(?=L)", ""), (r"\AS(?=UGAR)", "X", "S"), (r"SH(?=EIM|OEK|OLM|OLZ)", "S"), (r"SH", "X"), (r"SI[OA]", "S", "S", "slavo"), (r"SI[OA]", "S", "X"), (r"SZ|\AS(?=[MNLW])", "S", "X"),
        (r"SCH(?=E[RN])", "X", "SK"), (r"SCH(?=OO|UY|ED|EM)", "SK"), (r"\ASCH(?![AEIOUYW])", "X", "S"), (r"SCH", "X"), (r"SC[IEY]", "S"), (r"SC.?", "SK"), (r"(?<=[AO]I)S\Z", "", "S"), (r"SS?", "S"),
    ),
    "T": rules((r"TIO(?=N)|TIA|TCH", "X"), (r"TH(?=[OA]M)", "T"), (r"TH|TT(?=H)", "T", "T", "sch"), (r"TH|TT(?=H)", "0", "T"), (r"T[TD]?", "T")),
    "V": rules((r"\x56\x56?", "F")),
    "W": rules((r"WR", "R"), (r"\AW(?=V)", "A", "F"), (r"\AW(?=H)", "A"), (r"(?<=V)W\Z|(?<=[EO])W(?=SK[IY])", "", "F"), (r"W", "", "F", "sch"), (r"WI[CT]Z", "TS", "FX"), (r"W", "")),
    "X": rules((r"\AX", "S"), (r"(?<=[AO]U)X\Z", ""), (r"X[CX]?", "KS")),
    "Z": rules((r"ZH", "J"), (r"ZZ(?=[OIA])", "S", "TS"), (r"(?<=[^T])ZZ?", "S", "TS", "slavo"), (r"ZZ?", "S")),
}
#: Properties of a whole word: a pattern that stands somewhere in it.
PROPERTIES = {"slavo": ways("W|K|CZ"), "sch": ways(r"\ASCH"), "mc": ways(r"\AMC"), "anger": ways(r"\A[DRM]ANGER"), "ends": ways(r"[AO]S?\Z")}
#: A first letter that is not spoken.
SILENT = ways(r"\A(?:[GKP](?=N)|W(?=R)|P(?=S))")
_MOST = 6
#: Letters with a code of their own; at a word's start a soft g takes the vowel after it along.
_BLANKS = re.compile(rb"[\t-\r ]+")
_LEADING = re.compile("\\A(?:İ|[ğĞ](?:İ|[ğĞ])*[AEIOUYaeiouy]?)+".encode().replace("[ğĞ]".encode(), "(?:ğ|Ğ)".encode()))
_MAPPED = {**dict.fromkeys("çÇßẞ", b"S"), **dict.fromkeys("ñÑ", b"N"), **dict.fromkeys("ıİ", b"I"), **dict.fromkeys("ğĞ", b"")}
_MAPPED = {k.encode(): v for k, v in _MAPPED.items()}
_LETTER = re.compile(b"|".join(_MAPPED))


def cleaned(text: str) -> bytes:
    """The word as upper-cased bytes without blanks, in which some letters count as ASCII ones."""
    word = text.encode()
    if text.isascii() and word.isalnum():
        return word.upper()
    word = _LEADING.sub(b"", _BLANKS.sub(b"", word))
    return _LETTER.sub(lambda m: _MAPPED[m[0]], word.upper())


def met(data: np.ndarray, at: np.ndarray, tried: tuple[Way, ...]) -> np.ndarray:
    """How many bytes the first way that fits reads at each place, -1 if none fits."""
    out = np.full(len(at), -1)
    rest = np.arange(len(at))
    for way in tried:
        fits = rest
        for place, allowed in way.needs:
            fits = fits[allowed[data[at[fits] + place]]]
        for ban in way.bans:
            hit = np.ones(len(fits), bool)
            for place, allowed in ban:
                hit &= allowed[data[at[fits] + place]]
            fits = fits[~hit]
        out[fits] = way.size
        rest = rest[out[rest] < 0]
    return out


_RULES = [rule for letter in METAPHONE for rule in METAPHONE[letter]]
_CODES = [np.array([b"", *(getattr(r, name) for r in _RULES)], "S4") for name in ("primary", "alternate")]


def metaphones(texts: Sequence[str | None]) -> list[list[str] | None]:
    """The distinct non-empty codes of each word, the primary first.

    The words stand one after the other in one array of bytes. For each letter all its places are held
    against its rules at once; then all words walk from rule to rule together.
    """
    words = [b"" if t is None else cleaned(t) for t in texts]
    edge = bytes([EDGE])
    data = np.frombuffer(edge * 8 + edge.join(words) + edge * 8, np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = 8 + np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(words)), sizes)
    places = np.flatnonzero(data != EDGE)
    of_place = np.zeros(len(data), np.int64)
    of_place[places] = owner
    known = {name: np.zeros(len(words) + 1, bool) for name in PROPERTIES}
    for name, tried in PROPERTIES.items():
        known[name][owner[met(data, places, tried) >= 0]] = True
    # What is read and added at each place, were a word's walk to come by.
    step, rule = np.ones(len(data), np.int64), np.zeros(len(data), np.int64)
    number = 0
    for letter, own in METAPHONE.items():
        rest = np.flatnonzero(data == letter.encode("latin-1")[0])
        for r in own:
            number += 1
            at = rest
            if r.when or r.unless:
                at = at[known[r.when or r.unless][of_place[at]] == bool(r.when)]
            size = met(data, at, r.ways)
            fits = at[size >= 0]
            step[fits], rule[fits] = size[size >= 0], number
            rest = rest[rule[rest] == 0]
    at = np.flatnonzero(sizes)
    walk = starts[at]
    walk = walk + (met(data, walk, SILENT) >= 0)
    visited = np.zeros(len(data), bool)
    while len(walk):
        walk = walk[data[walk] != EDGE]
        visited[walk] = True
        walk = walk + step[walk]
    on = np.flatnonzero(visited & (rule > 0))
    codes = []
    for table in _CODES:
        count = np.char.str_len(table)[rule[on]]
        ends = np.cumsum(np.bincount(of_place[on], count, len(words)).astype(np.int64))
        letters = table.view(np.uint8).reshape(len(table), -1)[rule[on]]
        flat = letters[np.arange(letters.shape[1]) < count[:, None]].tobytes().decode()
        codes.append([flat[i : min(i + _MOST, j)] for i, j in pairwise([0, *ends.tolist()])])
    return [None if t is None else [p, a] if p and a and p != a else [p or a] if p or a else [] for t, p, a in zip(texts, *codes, strict=True)]


def metaphone(text: str | None) -> list[str] | None:
    return metaphones([text])[0]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _metaphone(text: pd.Series) -> pd.Series:
    codes, values = pd.factorize(text, use_na_sentinel=True)
    encoded = metaphones(list(values))
    return pd.Series([None if c < 0 else encoded[c] for c in codes], index=text.index, dtype=object)


def double_metaphone(text: Column | str) -> Column:
    """Array of a word's Double Metaphone codes of six characters at most: primary, alternate or both.

    Empty for words that leave no code. Letters outside ASCII count byte by byte, so fold such
    texts with :func:`lexmesh.functions.unaccent` first.
    """
    return _metaphone(column(text))
