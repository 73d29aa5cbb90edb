"""Toxicity scores from a lexicon trie, Levenshtein automata and context windows.

The lexicon is learned from labelled rows: words that stand in many different contexts of
toxic texts and hardly in clean ones. A word of a text matches a term if the word's
Levenshtein automaton, run along the lexicon's trie, accepts it within the distance that
the term's length allows; forms that clean labelled texts use are not misspellings. Each
hit is weighed by the words around it: quotation marks about it and words of reporting
lower it, direct address raises it; what a mark or a word weighs is learned from the hits
in labelled rows, starting from fixed lists. A logistic curve fitted to the labelled rows
turns a text's sum of hits into a score. Texts are lower-cased first, whatever the script.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.quality_classifier import fit_logistic
from lexmesh.llm.shared import hash_sample, materialise, remainder
from lexmesh.llm.textbytes import Texts, sliced

_TRIM = np.zeros(256, bool)
_TRIM[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
# Last bytes of two-byte marks (« » ¡ ¿) and of three-byte ones (dashes, quotes, ellipsis).
_TWO, _THREE = np.zeros(256, bool), np.zeros(256, bool)
_TWO[[0xAB, 0xBB, 0xA1, 0xBF]] = True
_THREE[[*range(0x90, 0x96), *range(0x98, 0xA0), 0xA6, 0xB9, 0xBA]] = True
#: Words of reporting and of direct address, in the languages at hand; fixed lists.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes term word slur insult sagte schrieb nannte wort zitat dijo escribió llamó palabra cita dit écrit appelé mot citation".split())
ADDRESS = frozenset("you your you're u ur du dich dein deine ihr tu te ton toi vous tú ti usted".split())
PRIOR = {w: 0.6 for w in REPORTING} | {w: 1.3 for w in ADDRESS}
#: What a hit in quotation marks weighs before any is seen, and hits that such a first weight counts as.
QUOTED, PRIOR_HITS = 0.25, 20.0
QUOTES = ('"', "“", "”", "„", "«", "»", "‘", "’")


def allowed(term: str) -> int:
    """Edits that a term of this length may suffer."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Levenshtein automaton of a word for up to k edits.

    A state holds, for each number d of edits, the set of lengths of the word's beginnings that
    what was read may be with d edits at most, as the bits of an integer.
    """

    def __init__(self, word: str, k: int):
        self.size, self.k, self.full = len(word), k, (2 << len(word)) - 1
        self.at: dict[str, int] = {}
        for i, char in enumerate(word):
            self.at[char] = self.at.get(char, 0) | 1 << i

    def start(self) -> tuple[int, ...]:
        return tuple((2 << d) - 1 & self.full for d in range(self.k + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        here = self.at.get(char, 0)
        fewer, last = 0, 0
        out = []
        for now in state:
            # Read as the word's next character, as an extra one or in place of one; or the word's next is skipped.
            last = ((now & here) << 1 | fewer | fewer << 1 | last | last << 1) & self.full
            out.append(last)
            fewer = now
        return tuple(out)

    def alive(self, state: tuple[int, ...]) -> bool:
        return state[-1] != 0

    def distance(self, state: tuple[int, ...]) -> int:
        """Edits between the whole word and what was read; k + 1 if there are more."""
        return next((d for d, now in enumerate(state) if now >> self.size & 1), self.k + 1)


class Trie:
    """The lexicon as nested dicts; ``""`` marks the end of a term."""

    def __init__(self, terms: Iterable[str]):
        self.root: dict = {}
        self.terms = sorted(terms)
        self.allowed = {t: allowed(t) for t in self.terms}
        for term in self.terms:
            node = self.root
            for char in term:
                node = node.setdefault(char, {})
            node[""] = term
        self.k = max(self.allowed.values(), default=0)

    def nearest(self, word: str) -> tuple[str, int] | None:
        """The nearest term (then the first) within its allowed distance, and the distance."""
        automaton, best = Automaton(word, self.k), None
        stack = [(self.root, automaton.start())]
        while stack:
            node, row = stack.pop()
            term = node.get("")
            if term is not None and (d := automaton.distance(row)) <= self.allowed[term] and (best is None or (d, term) < best[::-1]):
                best = (term, d)
            for char, child in node.items():
                if char and automaton.alive(after := automaton.step(row, char)):
                    stack.append((child, after))
        return best


class Matcher:
    """Finds the words of texts that match a lexicon; remembers the words it has seen."""

    def __init__(self, terms: Iterable[str], clean_forms: Iterable[str] = ()):
        self.trie, self.clean_forms, self.seen = Trie(terms), frozenset(clean_forms), {}
        # By pigeonhole a match keeps one of k + 1 pieces of its term, shifted by k characters at most.
        # An edit changes a word's bytes by four at most.
        self.pieces: dict[tuple[int, int, bool, int, int], set[bytes]] = {}
        for term in self.trie.terms:
            k, n = self.trie.allowed[term], len(term)
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                piece, size = term[a:b].encode(), len(term.encode())
                if i == 0 or i == k:
                    self.pieces.setdefault((0, len(piece), i > 0, size - 4 * k, size + 4 * k), set()).add(piece)
                else:
                    at = len(term[:a].encode())
                    for shift in range(-4 * k, 4 * k + 1):
                        if at + shift >= 0:
                            self.pieces.setdefault((at + shift, len(piece), False, size - 4 * k, size + 4 * k), set()).add(piece)
        self.tables = {key: np.sort(self.hashed(sorted(v))) for key, v in self.pieces.items()}

    @staticmethod
    def hashed(pieces: list[bytes]) -> np.ndarray:
        texts = Texts(pa.array([p.decode("utf-8", "surrogateescape") for p in pieces]))
        return texts.hashes(texts.offsets[:-1], texts.offsets[1:], True)

    def likely(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, sizes = np.zeros(len(starts), bool), ends - starts
        for (at, size, last, least, most), table in self.tables.items():
            rows = np.flatnonzero(~out & (sizes >= max(at + size, least)) & (sizes <= most))
            a = ends[rows] - size if last else starts[rows] + at
            h = texts.hashes(a, a + size, True)
            i = np.minimum(np.searchsorted(table, h), len(table) - 1)
            out[rows[table[i] == h]] = True
        return out

    def hits(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str, int]], tuple]:
        """Text and word number of each hit, what was hit (form, term, distance), and the words."""
        text, starts, ends = words = texts.words()
        starts, ends = trimmed(texts, starts, ends)
        full = np.flatnonzero(ends > starts)
        hashes, first, inverse = np.unique(texts.hashes(starts[full], ends[full], True), return_index=True, return_inverse=True)
        found: list = [None] * len(hashes)
        starts, ends = starts[full][first], ends[full][first]
        likely = self.likely(texts, starts, ends) if self.tables else np.zeros(len(hashes), bool)
        for i in np.flatnonzero(likely):
            key = int(hashes[i])
            if key not in self.seen:
                form = texts.slice(starts[i], ends[i]).lower()
                near = None if form in self.clean_forms else self.trie.nearest(form)
                self.seen[key] = None if near is None else (form, *near)
            found[i] = self.seen[key]
        chosen = np.array([f is not None for f in found], bool)
        at = full[chosen[inverse]] if len(full) else full
        return text[at], at, [found[i] for i in (inverse[chosen[inverse]] if len(full) else [])], words


def lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pc.utf8_lower(batch.column(at)))


def trimmed(texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches without ASCII punctuation, typographic quotes, dashes and Spanish marks at their ends."""
    starts, ends = starts.copy(), ends.copy()
    data, last = texts.data, max(len(texts.data) - 1, 0)

    def byte(at: np.ndarray) -> np.ndarray:
        return data[np.clip(at, 0, last)]

    def mark(first: np.ndarray, size: np.ndarray, end: bool) -> np.ndarray:
        """Bytes of the mark that opens (or ends) a stretch; 0 if none does."""
        at = [first - k if end else first + k for k in range(3)]
        one = _TRIM[byte(at[0])]
        lead, tail = (at[1], at[0]) if end else (at[0], at[1])
        two = (size >= 2) & (byte(lead) == 0xC2) & _TWO[byte(tail)]
        lead, tail = (at[2], at[0]) if end else (at[0], at[2])
        three = (size >= 3) & (byte(lead) == 0xE2) & (byte(at[1]) == 0x80) & _THREE[byte(tail)]
        return np.where(size < 1, 0, np.where(one, 1, np.where(two, 2, np.where(three, 3, 0))))

    rows = np.arange(len(starts)) if len(data) else np.zeros(0, np.int64)
    for end in (False, True):
        left = rows
        while len(left):
            step = mark(ends[left] - 1 if end else starts[left], ends[left] - starts[left], end)
            if end:
                ends[left] -= step
            else:
                starts[left] += step
            left = left[step > 0]
    return starts, ends


def context(before: list[str], own: str, after: list[str]) -> tuple[bool, list[str]]:
    """Whether a hit stands in quotation marks, and the words of its window."""
    quoted = own[:1] in QUOTES or own.rstrip(".,;:!?")[-1:] in QUOTES
    opened = sum(w.count(q) for w in before for q in QUOTES if q not in "‘’") % 2 == 1
    quoted |= opened and any(q in w for w in [own, *after] for q in QUOTES)
    return quoted, [w.strip(".,;:!?\"'()“”„«»‘’").lower() for w in before + after]


def context_weight(before: list[str], own: str, after: list[str], words: dict[str, float] = PRIOR, quoted: float = QUOTED) -> float:
    """How abusive a hit is, from its window: the weight of quotation, of its lowest and of its highest word."""
    marks, near = context(before, own, after)
    known = [words[w] for w in near if w in words]
    return (quoted if marks else 1.0) * min([1.0, *known]) * max([1.0, *known])


@dataclass
class Model:
    """Lexicon, forms that are not misspellings, and the curve from hits to a score."""

    terms: list[str] = field(default_factory=list)
    clean_forms: list[str] = field(default_factory=list)
    words: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    quoted: float = QUOTED
    slope: float = 6.0
    bias: float = -2.5
    window: int = 6

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(total) + self.bias, -30, 30)))


def windows(texts: Texts, matcher: Matcher, window: int) -> Iterator[tuple[int, str, str, int, tuple[list[str], str, list[str]]]]:
    """(text, form, term, distance, words before, at and after) of each hit."""
    owner, at, what, (text, starts, ends) = matcher.hits(texts)
    for t, i, (form, term, d) in zip(owner.tolist(), at.tolist(), what, strict=True):
        a, b = max(i - window, 0), min(i + window + 1, len(text))
        near = [(j, texts.slice(starts[j], ends[j])) for j in range(a, b) if text[j] == t]
        yield t, form, term, d, ([w for j, w in near if j < i], texts.slice(starts[i], ends[i]), [w for j, w in near if j > i])


def weighed_hits(texts: Texts, matcher: Matcher, model: Model) -> list[tuple[int, str, str, int, float]]:
    """(text, form, term, distance, weight) of each hit; each edit costs a fifth of the weight."""
    return [(t, form, term, d, context_weight(*near, model.words, model.quoted) * (1 - 0.2 * d)) for t, form, term, d, near in windows(texts, matcher, model.window)]


def learn_context(rows: DataFrame, model: Model, prior: float = PRIOR_HITS) -> None:
    """Weights of the words around exact hits and of quotation, from labelled rows (``toxic``, ``text``).

    A weight is the share of toxic texts among the hits beside the word (each text and word once), over that
    share of all hits; ``prior`` hits of the first weight (1 for words outside the lists) are added.
    """

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms)
        for batch, texts in sliced(lowered(batches), "text"):
            seen = set()
            for t, _, _, d, near in windows(texts, matcher, model.window):
                if d == 0:
                    quoted, words = context(*near)
                    seen |= {(t, "w" + w) for w in words if w} | {(t, "all")} | ({(t, "quoted")} if quoted else set())
            at = [t for t, _ in seen]
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(at, pa.int64())), pa.array([w for _, w in seen], pa.string())], ["toxic", "word"])

    found = rows.mapInArrow(beside, "toxic int, word string").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("hits")).where("hits >= 3 OR word IN ('all', 'quoted')").toPandas()
    counts = {w: (int(t), int(n)) for w, t, n in zip(found["word"], found["toxic"], found["hits"], strict=True)}
    toxic, hits = counts.pop("all", (0, 0))
    base = (toxic + 1) / (hits + 1)

    def weight(key: str, first: float) -> float:
        t, n = counts.get(key, (0, 0))
        return min(max((t / base + prior * first) / (n + prior), 0.1), 2.0)

    model.quoted = weight("quoted", QUOTED)
    words = {w[1:] for w in counts if w[:1] == "w"} | set(PRIOR)
    model.words = {w: weight("w" + w, PRIOR.get(w, 1.0)) for w in words}


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 30000, min_contexts: int = 4, share: float = 0.95) -> Model:
    """Fit on at most ``max_rows`` labelled rows of ``docs`` (the first by a hash of the id).

    A term is a word of two letters or more in ``min_contexts`` different toxic texts at least, with as many different
    neighbours there (one passage that many texts have makes no terms), and with so many texts or neighbours that chance does not
    explain them, whose document rate in toxic texts is ``share`` of both rates together at least. Near forms
    that clean texts have are excluded one by one.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = docs.select("doc_id").distinct().join(marks, F.col("doc_id") == F.col("labelled_id"))
    sample = hash_sample(sample, max_rows, 3).select("labelled_id", "toxic")
    # At most max_rows rows of two numbers are broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).select("doc_id", "toxic", "text")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(lowered(batches), "text"):
            text, starts, ends = texts.words()
            a, b = trimmed(texts, starts, ends)
            h = texts.hashes(starts, ends, True)
            pair = np.zeros(len(h), np.uint64)
            pair[1:-1] = h[:-2] * np.uint64(3) + h[2:]
            full = np.flatnonzero(b - a >= 2)
            words = [texts.slice(a[i], b[i]).lower() for i in full]
            # Exact copies count as one text.
            own = texts.hashes(texts.offsets[:-1], texts.offsets[1:], True).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(pair[full].view(np.int64)), pa.array(own[text[full]])], ["word", "pair", "own"])

    toxic_words = materialise(rows.where("toxic = 1").mapInArrow(contexts, "word string, pair long, own long").groupBy("word").agg(F.countDistinct("pair").alias("contexts"), F.countDistinct("own").alias("toxic_docs")), "words")
    size = rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).toPandas().set_index("toxic")["n"]
    n_toxic, n_clean = int(size.get(1, 0)), int(size.get(0, 0))
    if not n_toxic or not n_clean:
        return Model()
    # So many texts or neighbours that not one of all the words has them in toxic texts alone by chance.
    chance = math.log(0.01 / max(toxic_words.count(), 1)) / math.log(n_toxic / (n_toxic + n_clean))
    needed = max(min_contexts, math.ceil(chance))
    toxic_words = toxic_words.where((F.least("contexts", "toxic_docs") >= min_contexts) & (F.greatest("contexts", "toxic_docs") >= needed)).toPandas()
    candidates = sorted(toxic_words["word"])

    def clean_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.sort(Matcher.hashed([w.encode() for w in candidates])) if candidates else np.zeros(0, np.uint64)
        for _, texts in sliced(lowered(batches), "text"):
            text, starts, ends = texts.words()
            a, b = trimmed(texts, starts, ends)
            h = texts.hashes(a, b, True)
            i = np.minimum(np.searchsorted(table, h), max(len(table) - 1, 0))
            on = np.flatnonzero(table[i] == h) if len(table) else np.zeros(0, np.int64)
            _, once = np.unique(np.stack([text[on].astype(np.uint64), h[on]]), axis=1, return_index=True)
            words = [texts.slice(a[j], b[j]).lower() for j in on[once]]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    clean = rows.where("toxic = 0").mapInArrow(clean_counts, "word string").groupBy("word").agg(F.count(F.lit(1)).alias("clean_docs")).toPandas()
    both = toxic_words.merge(clean, on="word", how="left").fillna({"clean_docs": 0})
    rate = both["toxic_docs"] / n_toxic
    terms = sorted(both["word"][rate / (rate + (both["clean_docs"] + 0.5) / n_clean) >= share])
    model = Model(terms)
    learn_context(rows, model)

    def hit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch, texts in sliced(lowered(batches), "text"):
            hits = weighed_hits(texts, matcher, model)
            at = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([h[1] for h in hits], pa.string()), pa.array([h[2] for h in hits], pa.string()), pa.array([h[3] for h in hits], pa.int32()), pa.array([h[4] for h in hits], pa.float64())], ["doc_id", "toxic", "form", "term", "distance", "weight"])

    found = rows.mapInArrow(hit_rows, "doc_id long, toxic int, form string, term string, distance int, weight double").groupBy("doc_id", "toxic", "form", "term", "distance").agg(F.sum("weight").alias("weight")).toPandas()
    near = found[found["distance"] > 0]
    per_form = near.groupby(["form", "toxic"]).size().unstack(fill_value=0).reindex(columns=[0, 1], fill_value=0)
    clean_rate, toxic_rate = (per_form[0] + 0.0) / n_clean, per_form[1] / n_toxic
    model.clean_forms = sorted(per_form.index[(clean_rate > 0) & (toxic_rate < share * (toxic_rate + clean_rate))])
    totals = found[~found["form"].isin(model.clean_forms) | (found["distance"] == 0)].groupby(["doc_id", "toxic"])["weight"].sum().reset_index()
    # Rows without a hit count with a total of zero.
    x = np.concatenate([totals["weight"].to_numpy(), [0.0, 0.0]])
    y = np.concatenate([totals["toxic"].to_numpy(float), [0.0, 1.0]])
    w = np.concatenate([np.ones(len(totals)), [max(n_clean - (totals["toxic"] == 0).sum(), 1e-9), max(n_toxic - (totals["toxic"] == 1).sum(), 1e-9)]])
    # The curve starts from one that counts as five rows.
    first = (np.array([model.slope / 10, model.bias]), np.zeros(2), 5 / w.sum() * np.eye(2))
    slope, bias = fit_logistic(np.log1p(x)[:, None] * 10, y, w, l2=1e-6, steps=2000, rate=0.02, pull=first)
    model.slope, model.bias = max(float(slope[0]) * 10, 0.5), float(bias)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms, model.clean_forms)
        for batch, texts in sliced(lowered(batches), "text"):
            total, exact, near = np.zeros(texts.n), np.zeros(texts.n, np.int64), np.zeros(texts.n, np.int64)
            for t, _, _, d, weight in weighed_hits(texts, matcher, model):
                total[t] += weight
                (near if d else exact)[t] += 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(total)), pa.array(exact), pa.array(near)], ["doc_id", "score", "n_exact", "n_misspelled"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, n_exact long, n_misspelled long")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_rows: int = 30000) -> DataFrame:
    """Toxicity of every row of ``docs`` (``doc_id``, ``text``).

    Learns from labelled rows whose crc32 of the id modulo 3 is not 1; ids, sources and languages
    are no inputs of a score. Returns doc_id, held_out, score, predicted, n_exact, n_misspelled.
    Null and empty texts have no hits and get the score of a text without hits; of several labels of
    an id the largest counts; repeated rows get equal scores; a null id is held in but never
    labelled; without labels of both kinds the lexicon is empty; other columns are ignored.
    """
    model = learn(docs.where(remainder("doc_id", 3) != 1), labels, max_rows)
    return scored(docs, model).withColumn("held_out", remainder("doc_id", 3) == 1).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
