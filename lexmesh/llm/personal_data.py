"""Personal data in texts, disguised ones included, with the places in the source.

A text passes a chain of transducers: homoglyphs, digits of all scripts and invisible characters;
entities; bracketed and spelled "at" and "dot"; spelled digits; letters in place of digits. Each rewrites
stretches of its input and keeps, for every character that it writes, the stretch of the source that it
stands for. The same detectors then run over source and normal form, and what they find in the normal
form goes back to places of the source.

What the detectors find in the source always stays. A span of the normal form is added if it has
a rewritten character in it and meets no span of its kind. Every step takes time linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.llm.textbytes import SLICE_BYTES, sliced

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where its run of digits starts, so runs are entered once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Letters of other scripts that look like the ASCII ones below them; fixed values.
LOOKALIKES = (
    "АВЕЅІЈКМНОРСТХУаеѕіјорсухһԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαιν",
    "ABESIJKMHOPCTXYaesijopcyxhdqwlABEZHIKMNOPTYXoaiv",
)
#: Marks that stand for ASCII ones; fixed values.
MARKS = {"@": "﹫", ".": "。․｡﹒·", "+": "﹢", "-": "‐‑‒–−﹣", "(": "❨⁽", ")": "❩⁾"}
#: Words of the texts' languages; fixed values.
DIGITS = [("zero", "oh", "null", "cero", "zéro"), ("one", "eins", "uno", "un"), ("two", "zwei", "zwo", "dos", "deux"), ("three", "drei", "tres", "trois"), ("four", "vier", "cuatro", "quatre"), ("five", "fünf", "cinco", "cinq"), ("six", "sechs", "seis"), ("seven", "sieben", "siete", "sept"), ("eight", "acht", "ocho", "huit"), ("nine", "neun", "nueve", "neuf")]
TIMES = {"double": 2, "triple": 3}
AT = "at|arroba|arobase|arobas|klammeraffe"
DOT = "dot|punkt|punto|point"
PLUS = "plus|más"
#: Domain ends that make a spelled address credible; fixed values.
ENDS = "com|org|net|edu|gov|mil|info|biz|io|co|me|dev|app|ai|eu|us|uk|de|at|ch|fr|be|es|it|nl|pt|pl|se|mx|ar|br|ca|au|in|jp"
#: A stretch counts as spelled digits, or as numbers with spelled dots, from so many of these words on.
LEAST_WORDS = 3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: str
    disguised: bool


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Runs of local characters before each @ with a domain after it."""
    last, at = 0, text.find("@")
    while at >= 0:
        own = text[last:at]
        start = at - (len(own) - len(own.rstrip(_LOCAL)))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        last = found.end() if found else at + 1
        if found:
            yield start, last
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def detected(text: str) -> list[tuple[int, int, int]]:
    """Kind, start and end of all identifiers in a text; those of one kind do not overlap. Ordered by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return [(kind, s, e) for s, kind, e in out]


@cache
def folds() -> np.ndarray:
    """What each code point under U+20000 becomes: itself, an ASCII character, or nothing (-1)."""
    out = np.arange(0x20000)
    for i in range(0x80, 0x20000):
        char = chr(i)
        kind = unicodedata.category(char)
        if kind == "Nd":
            out[i] = ord("0") + unicodedata.decimal(char)
        elif kind == "Zs":
            out[i] = 32
        elif kind == "Cf" or 0xFE00 <= i <= 0xFE0F:
            out[i] = -1
        elif kind[0] in "LPS" or 0x2460 <= i <= 0x24FF:
            plain = unicodedata.normalize("NFKC", char)
            if len(plain) == 1 and 32 < ord(plain) < 127:
                out[i] = ord(plain)
    for char, to in zip(*LOOKALIKES, strict=True):
        out[ord(char)] = ord(to)
    for to, own in MARKS.items():
        out[[ord(c) for c in own]] = ord(to)
    return out


class Normal:
    """A text and the stretch of the source that each of its characters stands for; ``changed`` ones were rewritten."""

    def __init__(self, source: str):
        points = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32)
        to = np.where(points < 0x20000, folds()[np.minimum(points, 0x1FFFF)], points.astype(np.int64))
        keep = np.flatnonzero(to >= 0)
        self.starts, self.ends, self.changed = keep, keep + 1, to[keep] != points[keep]
        # Whatever was taken out belongs to the character before it.
        gaps = np.flatnonzero(np.diff(keep) > 1)
        self.changed[gaps] = True
        self.text = to[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") if self.changed.any() or len(keep) < len(points) else source

    def rewrite(self, pattern: re.Pattern[str], pieces: Callable[[re.Match[str]], list[tuple[str, int, int]] | None]) -> None:
        """Replace matches by pieces, each written for a stretch of this text; None leaves a match alone."""
        texts, starts, ends, changed, last = [], [], [], [], 0
        for match in pattern.finditer(self.text):
            new = pieces(match)
            if new is None:
                continue
            texts.append(self.text[last : match.start()])
            for own, mine in ((starts, self.starts), (ends, self.ends), (changed, self.changed)):
                own.append(mine[last : match.start()])
            for text, begin, end in new:
                same = text == self.text[begin:end]
                texts.append(text)
                starts.append(self.starts[begin:end] if same else np.full(len(text), self.starts[begin]))
                ends.append(self.ends[begin:end] if same else np.full(len(text), self.ends[end - 1]))
                changed.append(self.changed[begin:end] if same else np.ones(len(text), bool))
            last = match.end()
        if texts:
            texts.append(self.text[last:])
            self.text = "".join(texts)
            self.starts, self.ends, self.changed = (np.concatenate([*own, mine[last:]]) for own, mine in ((starts, self.starts), (ends, self.ends), (changed, self.changed)))


def whole(to: str) -> Callable[[re.Match[str]], list[tuple[str, int, int]]]:
    return lambda m: [(to, m.start(), m.end())]


_FLAGS = re.IGNORECASE
_WORDS = {w: str(i) for i, words in enumerate(DIGITS) for w in words}
_SPELLED = "|".join(sorted(_WORDS, key=len, reverse=True))
_GAP = r"[ \t,-]{1,3}"
_ELEMENT = rf"(?:(?:{'|'.join(TIMES)})[ -])?(?:{_SPELLED})\b|[0-9]+|(?:{DOT})\b|\."
_ENTITIES = [(re.compile(p, _FLAGS), whole(to)) for p, to in ((r"&#0*64;|&#x0*40;|&commat;|%40", "@"), (r"&#0*46;|&#x0*2e;|&period;", "."), (r"&#0*43;|&#x0*2b;|&plus;", "+"), ("&nbsp;|&#160;", " "))]
_BRACKETS = [(re.compile(rf"[ \t]{{0,2}}[(\[{{<][ \t]{{0,2}}(?:{own})[ \t]{{0,2}}[)\]}}>][ \t]{{0,2}}", _FLAGS), whole(to)) for own, to in ((f"{AT}|@|a", "@"), (rf"{DOT}|\.", "."))]
#: Words and numbers in a row, after a plus or not.
_SEQUENCE = re.compile(rf"(?:(?<!\w)(?:{PLUS})[ \t]{{1,2}}|\+[ \t]{{0,2}})?(?<![\w.])(?:{_ELEMENT})(?:(?:{_GAP}|(?<=[0-9])(?=\.)|(?<=\.)(?=[0-9]))(?:{_ELEMENT}))++", _FLAGS)
_ELEMENTS = re.compile(rf"(?:(?P<times>{'|'.join(TIMES)})[ -])?(?P<word>{_SPELLED})\b|(?P<number>[0-9]+)|(?P<dot>(?:{DOT})\b|\.)", _FLAGS)
_PLUS_NUMBER = re.compile(rf"(?<!\w)(?:{PLUS})[ \t]{{1,2}}(?=[0-9(][0-9 ().-]{{9,40}}(?![\w]))", _FLAGS)
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]{0,3}[0-9])[0-9OolI]{2,24}(?![A-Za-z0-9])|(?<=[0-9lI]\.)[OolI](?=\.[0-9OolI])")
_LETTERS = str.maketrans("OolI", "0011")
_LABEL = "[A-Za-z0-9-]{1,63}"
_NAME = "[A-Za-z0-9_%+-]{1,64}"
_SPELLED_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?: (?:{DOT}) {_NAME}){{0,4}} (?:{AT}) {_LABEL}(?:(?:\.| (?:{DOT}) ){_LABEL}){{0,4}} (?:{DOT}) (?:{ENDS})(?![A-Za-z0-9-])", _FLAGS)
#: A name that looks like a mailbox (a letter, and a digit, dot or underscore) may have plain dots after a spelled "at".
_MAILBOX_AT = re.compile(rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z%+-]*[._0-9])(?=[0-9._%+-]*[A-Za-z])[A-Za-z0-9._%+-]{{2,63}}(?<![._%+-]) (?:{AT}) {_LABEL}(?:\.{_LABEL}){{0,4}}\.(?:{ENDS})(?![A-Za-z0-9-])", _FLAGS)
_PARTS = re.compile(rf" (?:(?P<at>{AT})|(?P<dot>{DOT})) ", _FLAGS)
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9_%+-]) {1,2}@ {1,2}(?=[A-Za-z0-9])")
_SPACED_DOMAIN = re.compile(rf"(?<=@){_LABEL}(?:(?:\.| {{1,2}}(?:\.|{DOT}) {{1,2}}){_LABEL}){{0,4}} {{1,2}}(?:\.|{DOT}) {{1,2}}(?:{ENDS})(?![A-Za-z0-9-])", _FLAGS)
_SPACED_DOT = re.compile(rf" {{1,2}}(?:\.|{DOT}) {{1,2}}", _FLAGS)


def sequence(match: re.Match[str]) -> list[tuple[str, int, int]] | None:
    """Spelled digits and dots of a row as characters; gaps between spelled digits and around dots go."""
    text = match.string
    found = list(_ELEMENTS.finditer(text, match.start(), match.end()))
    if any(m["word"] and m["word"].lower() not in _WORDS for m in found):
        return None  # letters that only fold to ASCII ones
    if sum(m["word"] is not None for m in found) < LEAST_WORDS and sum(m["dot"] not in (None, ".") for m in found) < LEAST_WORDS:
        return None
    out, before = [], None
    if found[0].start() > match.start():
        out.append(("+", match.start(), found[0].start()))
    for m in found:
        if before is not None and m.start() > before.end() and not (m["dot"] or before["dot"] or (m["word"] and before["word"])):
            gap = text[before.end()]
            out.append((gap if gap in " -" else " ", before.end(), m.start()))
        value = _WORDS[m["word"].lower()] * TIMES.get((m["times"] or "").lower(), 1) if m["word"] else "." if m["dot"] else m["number"]
        out.append((value, m.start(), m.end()))
        before = m
    return out


def mixed(match: re.Match[str]) -> list[tuple[str, int, int]] | None:
    own = match[0]
    digits = sum(c.isdigit() for c in own)
    if digits == len(own) or (len(own) > 1 and 2 * digits < len(own)):
        return None
    return [(c.translate(_LETTERS), match.start() + i, match.start() + i + 1) for i, c in enumerate(own)]


def spelled_email(match: re.Match[str]) -> list[tuple[str, int, int]]:
    out, last = [], match.start()
    for m in _PARTS.finditer(match.string, match.start(), match.end()):
        out += [(match.string[last : m.start()], last, m.start()), ("@" if m["at"] else ".", m.start(), m.end())]
        last = m.end()
    return [*out, (match.string[last : match.end()], last, match.end())]


def spaced_domain(match: re.Match[str]) -> list[tuple[str, int, int]]:
    out, last = [], match.start()
    for m in _SPACED_DOT.finditer(match.string, match.start(), match.end()):
        out += [(match.string[last : m.start()], last, m.start()), (".", m.start(), m.end())]
        last = m.end()
    return [*out, (match.string[last : match.end()], last, match.end())]


_RUNS = re.compile(r"[^\W\d_]+")
_SEQUENCED = frozenset(_WORDS) | frozenset(DOT.split("|"))
_AT_WORDS, _DOT_WORDS, _PLUS_WORDS = (frozenset(x.split("|")) for x in (AT, DOT, PLUS))
_SIGNS = re.compile(rf"&(?:#|commat|period|plus|nbsp)|%40|[(\[{{<][ \t]{{0,2}}(?:{AT}|{DOT}|@|a|\.)[ \t]{{0,2}}[)\]}}>]")
_MIXTURE = re.compile(r"[0-9](?:[oil]|\.[oil]\.)|[oil][0-9]")
_AT_DOTTED = re.compile(rf" (?:{AT}) [a-z0-9-]{{1,63}}\.")


def rules(text: str) -> list[tuple[re.Pattern[str], Callable]]:
    """The rules, in order, that a text has what they rewrite; cheap tests spare most texts the others."""
    low = text.lower()
    words = _RUNS.findall(low)
    held = set(words)
    out = []
    if _SIGNS.search(low):
        out += [*_ENTITIES, *_BRACKETS]
    if not _SEQUENCED.isdisjoint(held):
        flags = [w in _SEQUENCED for w in words]
        if any(a and b and c for a, b, c in zip(flags, flags[1:], flags[2:], strict=False)) or not TIMES.keys().isdisjoint(held):
            out.append((_SEQUENCE, sequence))
    if not _PLUS_WORDS.isdisjoint(held):
        out.append((_PLUS_NUMBER, whole("+")))
    if _MIXTURE.search(low):
        out.append((_MIXED, mixed))
    dots = not _DOT_WORDS.isdisjoint(held)
    if not _AT_WORDS.isdisjoint(held):
        if dots:
            out.append((_SPELLED_EMAIL, spelled_email))
        if _AT_DOTTED.search(low):
            out.append((_MAILBOX_AT, spelled_email))
    if "@" in text or out:
        out += [(_SPACED_AT, whole("@")), (_SPACED_DOMAIN, spaced_domain)]
    return out


def normalised(text: str) -> Normal | None:
    """The normal form of a text, None if it is the text itself."""
    out = None if text.isascii() else Normal(text)
    if own := rules(out.text if out else text):
        out = out or Normal(text)
        for pattern, pieces in own:
            out.rewrite(pattern, pieces)
    return out if out and out.changed.any() else None


def personal(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind."""
    if not text:
        return []
    base = detected(text)
    spans = [Span(KINDS[k], s, e, text[s:e], False) for k, s, e in base]
    normal = normalised(text)
    if normal is None:
        return spans
    taken = [sorted((s, e) for k, s, e in base if k == kind) for kind in range(4)]
    starts = [np.array([s for s, _ in own], np.int64) for own in taken]
    ends = [np.array([e for _, e in own], np.int64) for own in taken]
    for kind, s, e in detected(normal.text):
        if not normal.changed[s:e].any():
            continue
        begin, end = int(normal.starts[s]), int(normal.ends[e - 1])
        # Spans of one kind do not overlap, so both ends are in order: those that begin before this one's end less those that end by its start.
        if np.searchsorted(starts[kind], end) > np.searchsorted(ends[kind], begin, "right"):
            continue
        spans.append(Span(KINDS[kind], begin, end, normal.text[s:e], True))
    return sorted(spans, key=lambda x: (x.start, KINDS.index(x.kind)))


def find_personal(docs: DataFrame) -> DataFrame:
    """The spans of every whole text of ``docs`` (``doc_id``, ``text``): doc_id, spans.

    A span has kind (email, ip, card, phone), start and end (code points of the text, end exclusive), value (the
    normal form) and disguised (found in the normal form only). Null and empty texts have none; repeated rows and null
    ids are rows like any other; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in sliced(batches, "text", SLICE_BYTES):
            found = [[s._asdict() for s in personal(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("disguised", pa.bool_())]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, value string, disguised boolean>>")


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        out, last = [], 0
        for span in personal(text):
            if span.end > last:
                out += [text[last : max(span.start, last)], f"<{span.kind.upper()}>" if span.start >= last else ""]
                last = span.end
        return text if not out else "".join([*out, text[last:]])

    return pd.Series([one(None if t is None else t) for t in texts], dtype=object)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind (``<EMAIL>``); overlapping ones together by the first's."""
    return docs.withColumn("text", _redacted("text"))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, the numbers of spans of each kind found in the text as it stands, their digest, all spans as text, and n_disguised."""
    found = find_personal(docs)

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def is_kind(kind):
        return lambda s: s["kind"] == kind

    base = F.filter("spans", lambda s: ~s["disguised"])
    counts = [F.size(F.filter(base, is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["disguised"])).cast("long").alias("n_disguised"))
