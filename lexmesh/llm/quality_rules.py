"""Quality rules: a decision list learned from labelled statistics.

Statistics of each whole text are computed once. Sequential covering learns conjunctions
of thresholds on them: each rule is grown by the test that gains most information, pruned
on held-out rows, and kept while it pays; the rows it covers are then set aside. The list
comes out as one ordered Spark conditional expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.shared import free_prefix, hash_sample, materialise
from lexmesh.llm.textbytes import BLANK, SLICE_BYTES, Texts, mixed, runs, sliced

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct", "n_digits", "n_same_words")
_SYMBOL, _UPPER, _PUNCT, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_PUNCT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
_DIGIT[48:58] = True


def counts(texts: Texts) -> dict[str, np.ndarray]:
    """The COUNTS of each text."""
    data, n = texts.data, texts.n
    text, starts, ends = texts.words()
    inside = ~BLANK[data]
    hashes = texts.hashes(starts, ends, False)
    salt = text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)

    # Lines: \n-split; those with a word that equal an earlier line of the text.
    breaks = np.flatnonzero(data == 10)
    lefts = np.concatenate([texts.offsets[:-1], breaks + 1])
    rights = np.concatenate([breaks, texts.offsets[1:]])
    lefts.sort()
    rights.sort()
    owner = np.repeat(np.arange(n), np.bincount(texts.text_of(breaks), minlength=n)[:n] + 1)
    filled = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    lined = filled[rights] > filled[lefts]
    keys = mixed(texts.hashes(lefts[lined], rights[lined], False) + owner[lined].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    lines = np.bincount(owner[lined], minlength=n)
    _, at = np.unique(keys, return_index=True)
    distinct = np.bincount(owner[lined][at], minlength=n)

    # Words in windows of eight that the text has twice or more.
    windows, first = runs(hashes, text, 8)
    windows = mixed(windows + salt[first])
    order = np.argsort(windows)
    equal = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    cover = np.zeros(len(text) + 1, np.int64)
    np.add.at(cover, first[again], 1)
    np.add.at(cover, first[again] + 8, -1)
    covered = np.cumsum(cover[:-1]) > 0

    same = np.zeros(len(text), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    return {
        "n_words": np.bincount(text, minlength=n), "word_chars": texts.per_text(inside & ((data & 0xC0) != 0x80)), "n_symbols": texts.per_text(_SYMBOL[data]), "n_dup_lines": lines - distinct, "n_repeat_words": np.bincount(text[covered], minlength=n),
        "n_lines": lines, "n_upper": texts.per_text(_UPPER[data]), "n_punct": texts.per_text(_PUNCT[data]), "n_digits": texts.per_text(_DIGIT[data]), "n_same_words": np.bincount(text[same], minlength=n),
    }


def with_counts(docs: DataFrame, columns: list[str], prefix: str = "") -> DataFrame:
    """The given columns of ``docs`` (with ``text``) and the COUNTS, named with ``prefix``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(columns).schema), *(f"`{prefix}{c}` long" for c in COUNTS)])
    carried = list(dict.fromkeys([*columns, "text"]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in sliced(batches, "text", SLICE_BYTES // 4):
            found = counts(texts)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in columns), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], [*columns, *(prefix + c for c in COUNTS)])

    return docs.select(carried).mapInArrow(add, schema)


def statistics(prefix: str = "") -> dict[str, Column]:
    """What the rules test, as expressions over the COUNTS."""
    c = {x: F.col(prefix + x) for x in COUNTS}
    words, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    return {
        "words": c["n_words"].cast("double"), "word_length": c["word_chars"] / words, "symbols_per_word": c["n_symbols"] / words, "dup_line_share": c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)),
        "repeat_share": c["n_repeat_words"] / words, "upper_share": c["n_upper"] / chars, "punct_share": c["n_punct"] / chars, "digit_share": c["n_digits"] / chars, "same_share": c["n_same_words"] / words, "words_per_line": words / F.greatest(c["n_lines"], F.lit(1)),
    }


@dataclass(frozen=True)
class Rule:
    """All of the tests (statistic, ``<=`` or ``>``, threshold) hold: the row is rejected."""

    tests: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, op, at in self.tests:
            out &= x[name] <= at if op == "<=" else x[name] > at
        return out

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, at in self.tests:
            out &= stats[name] <= at if op == "<=" else stats[name] > at
        return out


def best_test(x: dict[str, np.ndarray], bad: np.ndarray, grid: dict[str, np.ndarray]) -> tuple[float, tuple[str, str, float] | None]:
    """The test with most gain: bad rows covered times the growth of log precision."""
    b, n = bad.sum(), len(bad)
    base, best, test = np.log2(max(b, 1e-9) / n), 0.0, None
    for name, cuts in grid.items():
        order = np.argsort(x[name], kind="stable")
        total = np.concatenate([[0], np.cumsum(bad[order])])
        at = np.searchsorted(x[name][order], cuts, "right")
        for op, bs, ns in (("<=", total[at], at), (">", b - total[at], n - at)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(bs > 0, bs * (np.log2(bs / np.maximum(ns, 1)) - base), 0.0)
            i = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[i] > best + 1e-9:
                best, test = float(gain[i]), (name, op, float(cuts[i]))
    return best, test


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_tests: int = 4, precision: float = 0.9, min_rows: int = 5, seed: int = 7) -> list[Rule]:
    """Rules for the bad rows by sequential covering; none if no rule reaches the precision."""
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(bad)) % 3 == 0
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    grid = {k: np.unique(np.quantile(v, np.linspace(0, 1, 201))) if len(v) else v for k, v in x.items()}
    grid = {k: (v[1:] + v[:-1]) / 2 for k, v in grid.items()}
    while len(rules) < max_rules:
        grow, prune = left & ~fold, left & fold
        if bad[grow].sum() < min_rows:
            break
        sub, target, tests = {k: v[grow] for k, v in x.items()}, bad[grow], []
        while len(tests) < max_tests and not target.all():
            gain, test = best_test(sub, target, grid)
            if test is None:
                break
            tests.append(test)
            kept = Rule((test,)).covers(sub)
            sub, target = {k: v[kept] for k, v in sub.items()}, target[kept]

        def worth(t: list) -> float:
            on = Rule(tuple(t)).covers(x) & prune
            hits, misses = bad[on].sum(), (~bad[on]).sum()
            return (hits - misses) / (hits + misses + 1)

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests.pop()
        rule = Rule(tuple(tests))
        on = rule.covers(x) & left
        if not tests or bad[on].sum() < min_rows or bad[on].mean() < precision:
            break
        rules.append(rule)
        left &= ~on
    return rules


def training_rows(counted: DataFrame, labels: DataFrame, max_rows: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Statistics and badness of at most ``max_rows`` labelled rows, the first by a hash of the id."""
    stats = statistics("__s_")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.min("quality").alias("label"))
    rows = hash_sample(counted.join(marks, F.col("doc_id") == F.col("labelled_id")), max_rows, 5, *(f"__s_{c}" for c in COUNTS))
    pdf = rows.select(*(c.alias(k) for k, c in stats.items()), "label").toPandas()
    return {k: pdf[k].to_numpy(float) for k in stats}, pdf["label"].to_numpy() == 0


def verdict(rules: list[Rule], prefix: str) -> Column:
    """True unless a rule rejects: one CASE with a branch for each rule, in order."""
    stats, out = statistics(prefix), F.when(F.lit(False), False)
    for rule in rules:
        out = out.when(rule.column(stats), False)
    return out.otherwise(True)


def base_failed(prefix: str) -> Column:
    return (F.col(prefix + "n_words") < 20) | (100 * F.col(prefix + "n_repeat_words") > 30 * F.col(prefix + "n_words"))


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = 20000) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (``doc_id``, ``text``).

    The list is learned from at most ``max_rows`` labelled rows (least label of an id). Null and
    empty texts have no words and fail the base rules; repeated rows are judged alike; without
    labels only the base rules reject; other columns are ignored.
    """
    counted = materialise(with_counts(docs.select("doc_id", "text"), ["doc_id"], "__s_"), "rules")
    rules = learn(*training_rows(counted, labels, max_rows))
    failed = base_failed("__s_")
    return counted.select("doc_id", *(F.col(f"__s_{c}").alias(c) for c in COUNTS[:5]), failed.alias("base_failed"), (~failed & verdict(rules, "__s_")).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, max_rows: int = 20000) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("labelled_id")).distinct()
    sample = hash_sample(marks.join(docs.select("doc_id").distinct(), F.col("doc_id") == F.col("labelled_id")), max_rows, 5).select("labelled_id")
    # At most max_rows ids are broadcast.
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"), "left_semi")
    rules = learn(*training_rows(with_counts(labelled, ["doc_id"], "__s_"), labels, max_rows))
    own = free_prefix(docs, "__s_")
    return with_counts(docs, docs.columns, own).where(~base_failed(own) & verdict(rules, own)).select(docs.columns)
