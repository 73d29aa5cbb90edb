"""Hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class given the words before it, times that of its
group in the class given the same words, times that of the token in its group. Class and
group each have a softmax over hashed features of the context (n-grams of words and of
word endings, and skips; those of the groups also hold the class); the token's share of its
group comes from counts over all training texts, by 64-bit hashes of the words. Words fall
in classes by their endings, which are clustered by the endings that stand beside them, so
a word that was never seen has a class too; the words of a class fall in groups by hash.

Training reads all training documents. Feature counts give the first weights; then each
update sums the expected counts over all tasks and moves the weights of both layers along
the gradient (observed less expected counts), scaled by the expected counts. All tables that
are sent around have a fixed, hashed size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm import chunks as ch
from lexmesh.llm.shared import materialise, remainder
from lexmesh.llm.textbytes import Texts, mixed

#: Endings, classes of endings, and groups of the words of a class.
ENDINGS, CLASSES, GROUPS = 512, 32, 16
KINDS = ENDINGS * GROUPS
#: Rows of the weight table that each feature hashes into: of the classes, and of the groups.
SIZES = (4096, 8192, 512, 512, 8192, 4096)
GROUP_SIZES = (8192, 4096, 4096)
#: Tokens whose softmax is worked out together, to be summed in tables and for themselves.
STEP, SHORT_STEP = 32_000, 8_000
#: Rows of a table that are summed as one vector (of 32 KB): a task that sums gets one of each task that counts.
BLOCK_ROWS = 256
_END = ENDINGS - 1


@dataclass
class Model:
    """The classes of the endings, the log shares of the groups in each class, and the weights of both layers."""

    classes: np.ndarray
    group_base: np.ndarray
    spans: np.ndarray
    weights: np.ndarray | None = None
    group_weights: np.ndarray | None = None


@dataclass
class Tokens:
    """Tokens of some texts: text, hash (its low bits are the ending, then the group), ending, place in the text."""

    text: np.ndarray
    hash: np.ndarray
    ending: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        texts = Texts(column)
        owner, starts, ends = texts.words()
        sizes = ends - starts
        # The ending: the last two bytes and the size up to four; of short words the whole.
        tail = np.maximum(starts, ends - np.where(sizes <= 3, 3, 2))
        ending = ((texts.hashes(tail, ends, True) + np.minimum(sizes, 4).astype(np.uint64)) % np.uint64(_END)).astype(np.int64)
        at = np.arange(len(owner)) + owner
        text = np.repeat(np.arange(texts.n), np.bincount(owner, minlength=texts.n) + 1)
        hashes, endings = np.zeros(len(text), np.uint64), np.full(len(text), _END)
        hashes[at], endings[at] = texts.hashes(starts, ends, True), ending
        hashes = (hashes & ~np.uint64(ENDINGS - 1)) | endings.astype(np.uint64)
        begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
        return cls(text, hashes, endings, np.arange(len(text)) - begins[text] if len(text) else text)

    def before(self, values: np.ndarray, k: int) -> np.ndarray:
        """The value k tokens earlier in the same text; 0 before its start."""
        out = np.zeros(len(values), values.dtype)
        out[k:] = values[:-k]
        out[self.place < k] = 0
        return out

    def features(self, classes: np.ndarray) -> np.ndarray:
        """For each feature (a row) the row of its part of the weight table that is on for each token."""
        word, ending = self.hash | np.uint64(1 << 63), (self.ending + 1).astype(np.uint64)
        kind = (classes[self.ending] + 1).astype(np.uint64)
        e, c = [None] + [self.before(ending, k) for k in (1, 2, 3)], [None] + [self.before(kind, k) for k in (1, 2, 3, 4, 5, 6)]
        keys = [self.before(word, 1), e[1] * np.uint64(1024) + e[2], e[2], e[3], (c[1] << np.uint64(12)) + (c[2] << np.uint64(6)) + c[3], (c[4] << np.uint64(12)) + (c[5] << np.uint64(6)) + c[6]]
        hashed = [mixed(k) % np.uint64(n) if n > ENDINGS else k % np.uint64(n) for k, n in zip(keys, SIZES, strict=True)]
        return np.stack([h.astype(np.uint16) for h in hashed])

    def groups(self) -> np.ndarray:
        return ((self.hash // np.uint64(ENDINGS)) % np.uint64(GROUPS)).astype(np.int64)

    def group_features(self, own: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """As :meth:`features`, for the groups of each token's ``own`` class.

        ``spans``: for each feature the first row of each class, and the end. A class has rows of its own.
        """
        word, ending = self.hash | np.uint64(1 << 63), (self.ending + 1).astype(np.uint64)
        keys = [self.before(word, 1), self.before(ending, 1) * np.uint64(1024) + self.before(ending, 2), self.before(word, 2)]
        first, size = spans.take(own, 1), np.diff(spans).astype(np.uint64).take(own, 1)
        return np.stack([a + (mixed(k) % n).astype(np.int64) for a, n, k in zip(first, size, keys, strict=True)]).astype(np.uint16)


def trained(doc_ids: pa.Array) -> np.ndarray:
    """Whether each document may be learned from."""
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 5 != 1 for d in doc_ids.to_pylist()], bool)


def training_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[Tokens]:
    for batch in ch.released(batches):
        for row in range(batch.num_rows):
            keep = trained(batch.column(1)[row].values)
            tokens = Tokens.of(batch.column(2)[row].values.filter(pa.array(keep)))
            if len(tokens.text):
                yield tokens


def keyed(table: np.ndarray, rows: int) -> pa.RecordBatch:
    """A table cut into blocks of rows, by block number."""
    parts = [table[i : i + rows].astype(np.float32).tobytes() for i in range(0, len(table), rows)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["key", "vector"])


def collected(df: DataFrame, columns: int, rows: int) -> np.ndarray:
    """The summed table of ``rows`` rows on the driver; its size is fixed."""
    parts = ch.summed(df).orderBy("key").collect()
    if not parts:
        return np.zeros((rows, columns))
    return np.concatenate([np.frombuffer(p["vector"], np.float32) for p in parts]).reshape(-1, columns).astype(float)


def learn_classes(chunks: DataFrame, rounds: int = 25) -> np.ndarray:
    """A class for each ending: clusters of endings with like neighbours; the end token's is its own."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ENDINGS * ENDINGS)
        for tokens in training_tokens(batches):
            inner = np.flatnonzero(tokens.place > 0)
            table += np.bincount(tokens.ending[inner - 1] * ENDINGS + tokens.ending[inner], minlength=ENDINGS * ENDINGS)
        yield keyed(table.reshape(ENDINGS, ENDINGS), 64)

    table = collected(chunks.mapInArrow(neighbours, "key int, vector binary"), ENDINGS, ENDINGS)
    after, before = table, table.T
    weight = table.sum(1) + table.sum(0) + 1e-9
    shape = np.hstack([np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1)) for x in (after, before)])
    u, s, _ = np.linalg.svd(shape - np.average(shape, axis=0, weights=weight), full_matrices=False)
    points = (u * s)[:_END, :16]
    # Start from the most frequent endings, then k-means weighted by frequency.
    centres = points[np.argsort(-weight[:_END], kind="stable")[: CLASSES - 1]]
    for _ in range(rounds):
        near = np.argmin(((points[:, None] - centres[None]) ** 2).sum(2), 1)
        for k in range(CLASSES - 1):
            if (own := near == k).any():
                centres[k] = np.average(points[own], axis=0, weights=weight[:_END][own])
    return np.append(near, CLASSES - 1)


def scores(weights: np.ndarray, features: np.ndarray, sizes: Sequence[int] = SIZES, base: np.ndarray | None = None) -> np.ndarray:
    """Sums of the weights of the features that are on: a row for each token."""
    starts = np.cumsum((0, *sizes))
    parts = [weights[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    z = parts[0].take(features[0], 0)
    if base is not None:
        z += base
    more = np.empty_like(z)
    for part, rows in zip(parts[1:], features[1:], strict=True):
        z += part.take(rows, 0, out=more, mode="clip")
    return z


def log_share(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The log of each row's softmax at its own column."""
    p = z.T.copy()
    p -= p.max(0)
    mine = p[own, np.arange(len(own))]
    return mine - np.log(np.exp(p, out=p).sum(0))


def blocks(features: np.ndarray, step: int = STEP) -> Iterator[slice]:
    for i in range(0, features.shape[1], step):
        yield slice(i, i + step)


def expected_counts(z: np.ndarray, features: np.ndarray, table: np.ndarray, sizes: Sequence[int] = SIZES) -> None:
    """Add the softmax of ``z`` to the rows of ``table`` whose features are on.

    The kinds are summed one by one, so that what is added to stays in the cache; ``table`` is best laid out by column.
    """
    p = z.T.copy()
    p -= p.max(0)
    np.exp(p, out=p)
    p /= p.sum(0)
    p = p.astype(float)
    for rows, start, size in zip(features.astype(np.int64), np.cumsum((0, *sizes)), sizes, strict=False):
        for kind, share in zip(table.T[:, start : start + size], p, strict=True):
            kind += np.bincount(rows, share, size)


def observed_counts(own: np.ndarray, features: np.ndarray, table: np.ndarray, sizes: Sequence[int] = SIZES) -> None:
    """Count the outcome ``own`` of each token in the rows of ``table`` whose features are on."""
    kinds = table.shape[1]
    for rows, start, size in zip(features.astype(np.int64), np.cumsum((0, *sizes)), sizes, strict=False):
        table[start : start + size] += np.bincount(rows * kinds + own, minlength=size * kinds).reshape(size, kinds)


def packed(*tables: np.ndarray) -> pa.RecordBatch:
    """Tables below one another in rows of one width, by block number."""
    return keyed(np.vstack([t.reshape(-1, CLASSES) for t in tables]), BLOCK_ROWS)


def class_spans(tokens: np.ndarray) -> np.ndarray:
    """For each feature of the groups the first row of each class, and the end: rows in proportion to the class's tokens."""
    share = np.cumsum(np.append(0, tokens))
    share /= share[-1]
    return np.stack([np.arange(CLASSES + 1) + np.floor(share * (n - CLASSES)).astype(np.int64) for n in GROUP_SIZES])


def learn_weights(chunks: DataFrame, model: Model, updates: int = 2, rate: float = 0.4, prior: float = 20.0, start: float = 0.3, group_start: float = 0.5, damping: float = 30.0) -> Model:
    """``model`` with the weights of both layers: from feature counts, then by gradient updates over all training tokens."""
    rows, group_rows = sum(SIZES), sum(GROUP_SIZES)
    classes, group_base, spans = model.classes, model.group_base, model.spans

    def observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, group_seen = np.zeros((rows, CLASSES)), np.zeros((group_rows, GROUPS))
        for tokens in training_tokens(batches):
            own = classes[tokens.ending]
            observed_counts(own, tokens.features(classes), seen)
            observed_counts(tokens.groups(), tokens.group_features(own, spans), group_seen, GROUP_SIZES)
        yield packed(seen, group_seen)

    def sums(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        table = collected(df, CLASSES, rows + group_rows * GROUPS // CLASSES)
        return table[:rows], table[rows:].reshape(-1, GROUPS)

    seen, group_seen = sums(chunks.mapInArrow(observed, "key int, vector binary"))
    # The third feature is on in one row for each token.
    share = seen[sum(SIZES[:2]) : sum(SIZES[:3])].sum(0) + 0.5
    share /= share.sum()
    # The first feature's rows also carry the classes' log shares, once.
    weights = start * (np.log((seen + prior * share) / (seen.sum(1, keepdims=True) + prior)) - np.log(share))
    weights[: SIZES[0]] += np.log(share)
    group_share = np.exp(np.vstack([group_base.repeat(n, 0) for n in np.diff(spans)]))
    group_weights = group_start * np.log((group_seen + prior * group_share) / (group_seen.sum(1, keepdims=True) + prior) / group_share)
    for _ in range(updates):
        now = replace(model, weights=weights.astype(np.float32), group_weights=group_weights.astype(np.float32))

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, group_table = np.zeros((CLASSES, rows)).T, np.zeros((GROUPS, group_rows)).T
            for tokens in training_tokens(batches):
                own, features = classes[tokens.ending], tokens.features(classes)
                group_features = tokens.group_features(own, spans)
                for part in blocks(features):
                    expected_counts(scores(now.weights, features[:, part]), features[:, part], table)
                    z = scores(now.group_weights, group_features[:, part], GROUP_SIZES, group_base[own[part]])
                    expected_counts(z, group_features[:, part], group_table, GROUP_SIZES)
            yield packed(table, group_table)

        table, group_table = sums(chunks.mapInArrow(expected, "key int, vector binary"))
        weights = weights + rate * np.clip((seen - table) / (table + damping), -1.5, 1.5)
        group_weights = group_weights + rate * np.clip((group_seen - group_table) / (group_table + damping), -1.5, 1.5)
    return replace(model, weights=weights.astype(np.float32), group_weights=group_weights.astype(np.float32))


def context_scores(model: Model, tokens: Tokens) -> np.ndarray:
    """Log probability of each token's class times that of its group in the class."""
    own, groups = model.classes[tokens.ending], tokens.groups()
    features, group_features = tokens.features(model.classes), tokens.group_features(own, model.spans)
    out = np.zeros(len(own))
    for part in blocks(features, SHORT_STEP):
        out[part] = log_share(scores(model.weights, features[:, part]), own[part])
        out[part] += log_share(scores(model.group_weights, group_features[:, part], GROUP_SIZES, model.group_base[own[part]]), groups[part])
    return out


def kind_counts(answers: DataFrame) -> np.ndarray:
    """Training tokens (first row) and distinct training tokens of each kind, summed in the tasks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * KINDS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.frombuffer(t, "<i8")
        vectors = [x.tobytes() for x in total.reshape(-1, ENDINGS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(vectors)), pa.int32()), pa.array(vectors, pa.binary())], ["key", "vector"])

    sums = ch.summed(answers.where("chunk = -1").select("totals").mapInArrow(parts, "key int, vector binary"), np.int64).orderBy("key").collect()
    return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["vector"], np.int64) for r in sums)]).reshape(2, -1) if sums else np.zeros((2, KINDS), np.int64)


def ask(doc_ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words of a chunk with their counts in its training documents."""
    tokens = Tokens.of(texts)
    learned = trained(doc_ids)[tokens.text]
    hashes, inverse = np.unique(tokens.hash, return_inverse=True)
    return hashes, np.bincount(inverse, learned, len(hashes)).astype(np.int64)


def score_texts(docs: DataFrame, updates: int = 2) -> DataFrame:
    """log10 probability of every whole text of ``docs`` (``doc_id``, ``text``), and a unigram base.

    Learns from documents whose crc32 of the id modulo 5 is not 1. Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score. Null and empty texts are the end token
    alone; repeated rows count and are scored each; a null id counts as the empty text in the
    split; with no training document all words are unknown; an empty table gives an empty
    result; other columns are ignored.
    """
    chunks = ch.chunked(docs)
    answers = materialise(ch.counted(chunks, ask, 1, KINDS), "counts")
    counts = kind_counts(answers)
    n, v = int(counts[0].sum()), int(counts[1].sum())
    classes = learn_classes(chunks)
    # Tokens and distinct tokens of each group of each class; a word that was never seen counts as one more.
    mass = np.zeros((2, CLASSES, GROUPS))
    np.add.at(mass, (slice(None), np.tile(classes, GROUPS), np.repeat(np.arange(GROUPS), ENDINGS)), counts)
    mass = mass[0] + 0.5 * (mass[1] + 1)
    group_base = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
    model = learn_weights(chunks, Model(classes, group_base, class_spans(mass.sum(1))), updates)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, texts, keys, counts in ch.with_answers(batches):
            tokens = Tokens.of(texts)
            c = ch.looked_up(keys, counts, tokens.hash)
            log_p = np.log((c + 0.5) / mass[classes[tokens.ending], tokens.groups()]) + context_scores(model, tokens)
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            size = len(doc_ids)
            yield pa.RecordBatch.from_arrays(
                [doc_ids, *map(pa.array, (np.bincount(tokens.text, minlength=size), np.bincount(tokens.text[c > 0], minlength=size), np.full(size, n), np.bincount(tokens.text, base, size), np.bincount(tokens.text, log_p / np.log(10), size)))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return ch.answered(chunks, answers).mapInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumn("held_out", remainder("doc_id", 5) == 1)
