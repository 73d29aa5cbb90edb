"""Co-training quality classifier over two views of a document.

The text view sees what the text is made of (its characters, hashed words, repetition);
the metadata view sees what the record says about it (source, language, length, layout of
lines). Two logistic models start from the labelled rows; in each round each model passes
its confident pseudo-labels on unlabelled rows to the other. Both are then calibrated
on held-out labelled rows and combined by a logistic model of the two calibrated scores,
which scores every whole document.

At most ``max_labelled`` labelled rows, the first by a hash of the id, are held by the driver.
The features of all rows are written once. Each round reads those of all other rows where they lie,
in numpy batches, and sends sums of fixed size over every confident one; scoring reads all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.quality_rules import counts
from lexmesh.llm.shared import Scratch, free_prefix, hash_sample, materialise
from lexmesh.llm.textbytes import SLICE_BYTES, Texts, sliced

WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 128, 64, 16


def text_view(texts: Texts, c: dict[str, np.ndarray]) -> np.ndarray:
    """Shares of bytes by value, of hashed words, and of repetition."""
    n = texts.n
    owner = np.repeat(np.arange(n), np.diff(texts.offsets))
    kinds = np.bincount(owner * 256 + texts.data, minlength=n * 256).reshape(n, 256)
    words, starts, ends = texts.words()
    hashed = np.bincount(words * WORD_BUCKETS + (texts.hashes(starts, ends, True) % np.uint64(WORD_BUCKETS)).astype(np.int64), minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    per = np.maximum(c["n_words"], 1)[:, None]
    extra = np.stack([c["n_same_words"], c["n_repeat_words"], c["n_punct"], c["n_upper"], c["word_chars"]], 1) / per
    return np.hstack([np.log1p(32 * kinds / np.maximum(np.diff(texts.offsets), 1)[:, None]), np.sqrt(hashed / per), extra]).astype(np.float32)


def metadata_view(part: pa.RecordBatch, texts: Texts, c: dict[str, np.ndarray]) -> np.ndarray:
    """Source and language (hashed; absent and null share a bucket), length, layout of lines."""
    out = np.zeros((texts.n, SOURCE_BUCKETS + LANG_BUCKETS + 6), np.float32)
    for name, start, size in (("source", 0, SOURCE_BUCKETS), ("lang", SOURCE_BUCKETS, LANG_BUCKETS)):
        at = part.schema.get_field_index(name)
        values = part.column(at).to_pylist() if at >= 0 else [None] * texts.n
        out[np.arange(texts.n), [start + (0 if v is None else 1 + zlib.crc32(str(v).encode()) % (size - 1)) for v in values]] = 1
    length, lines, words = np.diff(texts.offsets), np.maximum(c["n_lines"], 1), np.maximum(c["n_words"], 1)
    out[:, -6:] = np.stack([np.log1p(length), np.log1p(c["n_lines"]), np.log1p(length / lines), c["n_dup_lines"] / lines, c["n_words"] / lines / 100, np.log1p(length / words)], 1)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 250, rate: float = 0.05, pull: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the weighted logistic loss.

    ``pull`` (where to start, gradient and curvature there; the bias last) adds a quadratic term.
    """
    w, b = (pull[0][:-1], float(pull[0][-1])) if pull else (np.zeros(x.shape[1]), 0.0)
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = weight / weight.sum()
    for t in range(1, steps + 1):
        gap = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
        g = np.append(x.T @ gap + l2 * w, gap.sum())
        if pull:
            g += pull[1] + pull[2] @ (np.append(w, b) - pull[0])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def balanced(y: np.ndarray) -> np.ndarray:
    """Weights that give either label half of the total."""
    return np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))


@dataclass
class View:
    """A standardised logistic model of one view; ``scale`` and ``shift`` calibrate it."""

    mean: np.ndarray
    spread: np.ndarray
    w: np.ndarray
    b: float
    scale: float = 1.0
    shift: float = 0.0

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w + self.b

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.scale * self.raw(x) + self.shift


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, spread = x.mean(0), x.std(0) + 1e-3
    return View(mean, spread, *fit_logistic(np.clip((x - mean) / spread, -8, 8), y, balanced(y)))


@dataclass
class CoTrained:
    text: View
    meta: View
    w: np.ndarray
    b: float

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: text view, metadata view, both."""
        a, c = self.text.logit(text), self.meta.logit(meta)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, c, self.w[0] * a + self.w[1] * c + self.b))


def calibrated(model: View, x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make a view's raw scores log odds."""
    w, b = fit_logistic(model.raw(x)[:, None] / 4, y, np.ones(len(y)), l2=1e-4)
    return max(float(w[0]) / 4, 0.0), b


def combined(models: list[View], views: tuple[np.ndarray, np.ndarray], label: np.ndarray, held: np.ndarray, pull: float = 0.05) -> CoTrained:
    """Both views calibrated and combined on the held-out labelled rows.

    Views that are independent given the label add up: weights of 1, less the log odds of the labels. The
    combination is drawn to that by ``pull`` and fitted on scores that were calibrated on the other half of the rows.
    """
    y = label[held].astype(float)
    halves = (np.arange(len(y)) % 2 == 0, np.arange(len(y)) % 2 == 1)
    if not all(0 < y[h].sum() < h.sum() for h in halves):
        return CoTrained(models[0], models[1], np.array([0.5, 0.5]), 0.0)
    both = np.zeros((len(y), 2))
    for own, other in (halves, halves[::-1]):
        for i, (model, x) in enumerate(zip(models, views, strict=True)):
            scale, shift = calibrated(model, x[held][other], y[other])
            both[own, i] = scale * model.raw(x[held][own]) + shift
    for model, x in zip(models, views, strict=True):
        model.scale, model.shift = calibrated(model, x[held], y)
    start = np.array([1.0, 1.0, -np.log(y.mean() / (1 - y.mean()))])
    w, b = fit_logistic(np.clip(both, -6, 6), y, np.ones(len(y)), l2=0.0, pull=(start, np.zeros(3), pull * np.eye(3)))
    return CoTrained(models[0], models[1], np.maximum(w, 0.0), b)


def featured(docs: DataFrame) -> DataFrame:
    """Both views of every row, as 16-bit floats: doc_id, text_view, meta_view."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, "text", SLICE_BYTES // 4):
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([row.tobytes() for row in x.astype(np.float16)], pa.binary()) for x in both_views(part, texts))], ["doc_id", "text_view", "meta_view"])

    return docs.select("doc_id", "text", *(c for c in ("source", "lang") if c in docs.columns)).mapInArrow(features, "doc_id long, text_view binary, meta_view binary")


def both_views(part: pa.RecordBatch, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    c = counts(texts)
    return text_view(texts, c), metadata_view(part, texts, c)


def blocks(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
    """Parts of batches of features, and both views of their rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            yield part, tuple(np.frombuffer(b"".join(part.column(k).to_pylist()), np.float16).reshape(part.num_rows, -1).astype(np.float32) for k in (1, 2))


def confident_rows(logit: np.ndarray, label: int, confident: float) -> np.ndarray:
    sure = np.log(confident / (1 - confident))
    return logit >= sure if label else logit <= -sure


def pool_sums(features: DataFrame, models: list[View], known: list[int], confident: float, trusted: tuple[tuple[bool, bool], tuple[bool, bool]] = ((True, True), (True, True))) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Of each view as a pupil and each label its teacher gives: gradient sums and products of features.

    Sums run over every row of ``features`` but those of the ids ``known`` and of null ids, of which the
    other view is ``confident`` and in that label ``trusted`` (by teacher and label). The last feature is
    the constant 1, so the last product counts rows.
    """
    sizes = [len(m.w) + 1 for m in models]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[np.zeros((d + 1, d)) for _ in (0, 1)] for d in sizes]
        for part, views in blocks(batches):
            ids = part.column(0)
            free = ~pc.or_(pc.is_null(ids), pc.is_in(ids, pa.array(known, ids.type))).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                z, pupil = models[1 - k].logit(views[1 - k]), models[k]
                for label in (0, 1):
                    rows = free & confident_rows(z, label, confident) & trusted[1 - k][label]
                    x = np.hstack([pupil.standard(views[k][rows]), np.ones((rows.sum(), 1))])
                    gap = 1 / (1 + np.exp(-np.clip(x @ np.append(pupil.w, pupil.b), -30, 30))) - label
                    total[k][label][0] += gap @ x
                    x = x.astype(np.float32)
                    total[k][label][1:] += x.T @ x
        keys, sums = zip(*(((2 * k + label) * 10_000 + i, row.astype(np.float32).tobytes()) for k in (0, 1) for label in (0, 1) for i, row in enumerate(total[k][label])), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(sums, pa.binary())], ["key", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[key] = total.get(key, 0) + np.frombuffer(row, np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], ["key", "sums"])

    schema = "key int, sums binary"
    rows = features.mapInArrow(partial, schema).repartition("key").mapInArrow(add, schema).toPandas()
    found = [[np.zeros((d + 1, d)) for _ in (0, 1)] for d in sizes]
    for key, row in zip(rows["key"], rows["sums"], strict=True):
        found[key // 20_000][key // 10_000 % 2][key % 10_000] = np.frombuffer(row, np.float32)
    return [[(m[0], m[1:]) for m in pair] for pair in found]


def co_train_all(features: DataFrame, known: list[int], text: np.ndarray, meta: np.ndarray, label: np.ndarray, rounds: int = 4, confident: float = 0.95) -> CoTrained | None:
    """Fit on labelled rows and, in each round, on every other row of ``features``; None without rows of both labels.

    Teachers are calibrated on the held-out labelled rows, and teach a label only if they are right in it on
    these rows as often as they are ``confident``; a pupil learns from a teacher that gives both labels. The
    confident rows of a round weigh as much as the labelled ones, either label half. Their loss is bounded by
    its gradient and the largest curvature a logistic loss has, so no step raises the bounded loss.
    """
    held = np.arange(len(label))[::4]
    own = np.setdiff1d(np.arange(len(label)), held)
    if not 0 < label[own].sum() < len(own):
        return None
    views, y = (text, meta), label[own].astype(float)
    models = [fit_view(x[own], y) for x in views]
    for _ in range(rounds):
        trusted = []
        for model, x in zip(models, views, strict=True):
            if 0 < label[held].sum() < len(held):
                model.scale, model.shift = calibrated(model, x[held], label[held].astype(float))
            sure = [confident_rows(model.logit(x[held]), k, confident) for k in (0, 1)]
            trusted.append(tuple((2 + (label[held][rows] == k).sum()) / (2 + rows.sum()) >= confident for k, rows in enumerate(sure)))
        sums = pool_sums(features, models, known, confident, tuple(trusted))
        after = []
        for model, x, pair in zip(models, views, sums, strict=True):
            if min(products[-1, -1] for _, products in pair) < 1:
                after.append(View(model.mean, model.spread, model.w, model.b))
                continue
            share = [0.5 / max(products[-1, -1], 1) for _, products in pair]
            gradient = sum(u * g for u, (g, _) in zip(share, pair, strict=True))
            curvature = sum(0.25 * u * products for u, (_, products) in zip(share, pair, strict=True))
            w, b = fit_logistic(model.standard(x[own]), y, balanced(y), pull=(np.append(model.w, model.b), gradient, curvature))
            after.append(View(model.mean, model.spread, w, b))
        models = after
    return combined(models, views, label, held)


def fit(features: DataFrame, labels: DataFrame, max_labelled: int = 6000, rounds: int = 4) -> CoTrained | None:
    """Co-train on at most ``max_labelled`` labelled rows of ``features`` and on all others."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min("quality").cast("int").alias("label"))
    marked = features.select("doc_id").distinct().join(marks, F.col("doc_id") == F.col("labelled_id"))
    # At most max_labelled rows of two numbers are broadcast; the driver holds their features.
    sample = hash_sample(marked, max_labelled, 11).select("labelled_id", "label")
    rows = features.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).drop("labelled_id")
    pdf = hash_sample(rows, max_labelled, 11, "text_view", "meta_view").toPandas()
    if not len(pdf):
        return None
    text, meta = (np.stack([np.frombuffer(x, np.float16) for x in pdf[c]]).astype(np.float32) for c in ("text_view", "meta_view"))
    return co_train_all(features, sorted(set(pdf["doc_id"].tolist())), text, meta, pdf["label"].to_numpy(), rounds)


def scored(docs: DataFrame, model: CoTrained | None, columns: list[str], prefix: str = "") -> DataFrame:
    """The given columns of ``docs`` with text_score, meta_score and score."""
    names = [prefix + x for x in ("text_score", "meta_score", "score")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema), *(f"`{x}` double" for x in names)])
    needed = list(dict.fromkeys([*columns, "text", *(c for c in ("source", "lang") if c in docs.columns)]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, "text", SLICE_BYTES // 4):
            found = scores(model, *both_views(part, texts))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(x)) for x in columns), *(pa.array(x.astype(float)) for x in found)], [*columns, *names])

    return docs.select(needed).mapInArrow(add, schema)


def scores(model: CoTrained | None, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's scores of features rounded to 16 bits; 0.5 without a model."""
    if model is None:
        return (np.full(len(text), 0.5),) * 3
    return model.score(*(x.astype(np.float16).astype(np.float32) for x in (text, meta)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 6000) -> DataFrame:
    """Scores and verdict of every row of ``docs`` (``doc_id``, ``text``, if present ``source``, ``lang``).

    Returns doc_id, text_score, meta_score, score (probability of good quality) and kept
    (score >= threshold). Null texts are scored as empty ones; null ids are scored but never
    learned from; of several labels of an id the least counts; repeated rows get equal scores;
    without labels of both kinds all scores are 0.5; an empty table gives an empty result; other
    columns are ignored.
    """
    features = materialise(featured(docs), "features")
    model = fit(features, labels, max_labelled)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, views in blocks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(float)) for x in scores(model, *views))], ["doc_id", "text_score", "meta_score", "score"])

    return features.mapInArrow(score, "doc_id long, text_score double, meta_score double, score double").withColumn("kept", F.col("score") >= threshold)


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 6000) -> DataFrame:
    """The rows of ``docs`` that :func:`classify` keeps, with all their columns."""
    tables = Scratch(docs.sparkSession)
    model = fit(tables.write(featured(docs), "features"), labels, max_labelled)
    tables.clear()
    own = free_prefix(docs, "__q_")
    return scored(docs, model, docs.columns, own).where(F.col(own + "score") >= threshold).select(docs.columns)
