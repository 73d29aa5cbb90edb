"""Alignment of two tokenizers' tokens of the same texts.

Both tokenizers encode the whole text. Places where a token with a leading space starts in both are
anchors: there the tokens before end together, which is checked on the bytes. Anchors cut a
text into windows of token ids of both sides. How the tokens of a window group and link depends on its ids
alone, so each distinct window is aligned once and remembered by its ids.

A group is a stretch between places where tokens of both sides end. How many documents hold a pair of
ids in one group is counted over all documents by Spark, from the distinct pairs of each; the counts then
go back to the documents, broadcast if the pairs have been counted to be few enough, else by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.packing import Encoder, spread
from lexmesh.llm.shared import materialise
from lexmesh.llm.textbytes import SLICE_BYTES, mixed, powers, sliced

#: A pair of ids is a << ID_BITS | b.
ID_BITS = 20
#: Pairs whose counts are broadcast (17 bytes each); more are joined by a shuffle, each pair in so many salted pieces.
MOST_PAIRS, SALTS = 3_000_000, 16
#: Windows, and bytes of their groups as text, that a worker remembers.
MOST_WINDOWS, MOST_TEXT = 300_000, 60_000_000
#: Groups with more links are counted by their distinct ids.
MOST_LINKS = 4096


class PlainEncoder(Encoder):
    """The byte-level vocabulary's tokens of texts; special tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
        self.tokenizer.encode_special_tokens = True
        tokens = {i: token.encode() if token in self.special else bytes(letters[c] for c in token) for token, i in self.tokenizer.get_vocab().items()}
        self.special = set()
        self.bytes = TokenBytes([tokens.get(i, b"") for i in range(max(tokens) + 1)])


class PieceEncoder:
    """The piece vocabulary's tokens of texts that start with the space which the model adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = TokenBytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the start of each text's ids (and the end)."""
        found = self.model.encode([t[1:] for t in texts], num_threads=1)
        return np.concatenate([np.fromiter(ids, np.uint32, len(ids)) for ids in found]), np.concatenate([[0], np.cumsum([len(ids) for ids in found])])


class TokenBytes:
    """The bytes of each token id."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > 1 << ID_BITS:
            raise ValueError(f"vocabularies have {1 << ID_BITS} ids at most")
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t[:1] == b" " for t in tokens])

    def spell(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Marks the texts whose tokens have the bytes of the text one after the other."""
        totals = np.concatenate([[0], np.cumsum(self.sizes[ids])])[bounds]
        good = np.diff(totals) == np.diff(offsets)
        if not good.all():
            ids = ids[np.repeat(good, np.diff(bounds))]
            data = data[np.repeat(good, np.diff(offsets))]
        wrong = np.flatnonzero(self.data[spread(self.starts[ids], self.sizes[ids])] != data)
        edges = np.cumsum(np.diff(offsets)[good])
        good[np.flatnonzero(good)[np.searchsorted(edges, wrong, "right")]] = False
        return good


class Side(NamedTuple):
    """One side's tokens of a slice: ids, where they start and end, and the first token of each window (and the end)."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    cuts: np.ndarray

    def of(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of some windows, and how many each has."""
        sizes = self.cuts[windows + 1] - self.cuts[windows]
        return spread(self.cuts[windows], sizes), sizes


class Aligned(NamedTuple):
    """Some windows aligned: ids of both sides, groups as text, numbers of groups and links, linked pairs with how often."""

    ids: tuple[np.ndarray, np.ndarray]
    sizes: tuple[np.ndarray, np.ndarray]
    texts: list[str]
    groups: np.ndarray
    links: np.ndarray
    pairs: np.ndarray
    times: np.ndarray
    n_pairs: np.ndarray


@cache
def written_ids(n: int) -> np.ndarray:
    """The first n ids as text before each of the three signs that may follow one."""
    return np.array([[f"{i}{sign}" for i in range(n)] for sign in ",|;"], object)


def align(a: Side, b: Side, windows: np.ndarray) -> Aligned:
    """Align some windows, in ascending order, all at once."""
    (a_at, a_sizes), (b_at, b_sizes) = a.of(windows), b.of(windows)
    shared = np.intersect1d(a.ends[a_at], b.ends[b_at], assume_unique=True)
    a_group, b_group = np.searchsorted(shared, a.ends[a_at]), np.searchsorted(shared, b.ends[b_at])
    n_a, n_b = np.bincount(a_group, minlength=len(shared)), np.bincount(b_group, minlength=len(shared))
    a_ids, b_ids = a.ids[a_at], b.ids[b_at]
    # A group belongs to the window of its first token.
    first = np.cumsum(n_a) - n_a
    owner = np.repeat(np.arange(len(windows)), a_sizes)[first]
    groups = np.bincount(owner, minlength=len(windows))
    edges = np.cumsum(groups) - groups
    links = np.add.reduceat(n_a * n_b, edges)
    small = n_a * n_b <= MOST_LINKS
    kept = np.flatnonzero(small[a_group])
    counts = n_b[a_group[kept]]
    pairs = np.repeat(a_ids[kept] << ID_BITS, counts) | b_ids[spread((np.cumsum(n_b) - n_b)[a_group[kept]], counts)]
    times, of = np.ones(len(pairs), np.int64), np.repeat(owner[a_group[kept]], counts)
    for g in np.flatnonzero(~small):
        # Equal ids of a long group are counted together, so it costs its distinct ids.
        (x, n), (y, m) = (np.unique(ids[group == g], return_counts=True) for ids, group in ((a_ids, a_group), (b_ids, b_group)))
        pairs = np.append(pairs, (x[:, None] << ID_BITS | y[None]).ravel())
        times = np.append(times, (n[:, None] * m[None]).ravel())
        of = np.append(of, np.full(len(x) * len(y), owner[g]))
    if not small.all():
        order = np.argsort(of, kind="stable")
        pairs, times, of = pairs[order], times[order], of[order]
    # The tokens in the order in which they are written, each with the sign after it.
    side = np.concatenate([2 * a_group, 2 * b_group + 1])
    order = np.argsort(side, kind="stable")
    side = side[order]
    last = np.append(side[1:] != side[:-1], True)
    ids = np.concatenate([a_ids, b_ids])[order]
    words = written_ids(max(int(ids.max()) + 1, 1 << 16))[np.where(last, 1 + side % 2, 0), ids].tolist()
    ends = np.cumsum(a_sizes + b_sizes).tolist()
    texts = ["".join(words[i:j])[:-1] for i, j in pairwise([0, *ends])]
    return Aligned((a_ids, b_ids), (a_sizes, b_sizes), texts, groups, links, pairs, times, np.bincount(of, minlength=len(windows)))


class Windows:
    """Aligned windows, remembered by their ids: found by a hash of these, then compared with them."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bounds = [np.zeros(0, np.int64)] * 2, [np.zeros(1, np.int64)] * 2
        self.texts: list[str] = []
        self.text_bytes = 0
        self.groups, self.links, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def full(self) -> bool:
        return len(self.texts) > MOST_WINDOWS or self.text_bytes > MOST_TEXT

    def find(self, hashes: np.ndarray, sides: tuple[Side, Side], windows: np.ndarray) -> np.ndarray:
        """The number of each of some windows, -1 if it is not known."""
        if not len(self.keys):
            return np.full(len(windows), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        number = np.where(self.keys[at] == hashes, self.places[at], -1)
        for side, ids, bounds in zip(sides, self.ids, self.bounds, strict=True):
            rows = np.flatnonzero(number >= 0)
            own = number[rows]
            at, sizes = side.of(windows[rows])
            alike = sizes == bounds[own + 1] - bounds[own]
            number[rows[~alike]] = -1
            differs = side.ids[at[np.repeat(alike, sizes)]] != ids[spread(bounds[own[alike]], sizes[alike])]
            number[np.repeat(rows[alike], sizes[alike])[differs]] = -1
        return number

    def add(self, new: Aligned, hashes: np.ndarray, keep: np.ndarray) -> np.ndarray:
        """The numbers of new windows; those to ``keep`` can be found again."""
        number = len(self.texts) + np.arange(len(new.texts))
        self.texts += new.texts
        self.text_bytes += sum(map(len, new.texts))
        for k in range(2):
            self.ids[k] = np.append(self.ids[k], new.ids[k])
            self.bounds[k] = np.append(self.bounds[k], self.bounds[k][-1] + np.cumsum(new.sizes[k]))
        self.groups, self.links = np.append(self.groups, new.groups), np.append(self.links, new.links)
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(new.n_pairs))
        self.pairs, self.times = np.append(self.pairs, new.pairs), np.append(self.times, new.times)
        order = np.flatnonzero(keep)[np.argsort(hashes[keep])]
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.places = np.insert(self.keys, at, hashes[order]), np.insert(self.places, at, number[order])
        return number


class Aligner:
    """A worker's own encoders and remembered windows."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b, self.windows = PlainEncoder(a_path), PieceEncoder(b_path), Windows()

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its numbers of a tokens, b tokens, groups and links; its groups; the bounds of its distinct pairs, these and how often."""
        n = len(texts)
        numbers, groups = np.zeros((4, n), np.int64), [""] * n
        rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
        spaced = [" " + texts[i] for i in rows]
        coded = [t.encode("utf-8", "replace") for t in spaced]
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))])
        data = np.frombuffer(b"".join(coded), np.uint8)
        sides = [(self.a.bytes, *self.a.encode(spaced)), (self.b.bytes, *self.b.encode(spaced))] if len(rows) else []
        good = np.ones(len(rows), bool)
        for table, ids, bounds in sides:
            good &= table.spell(data, offsets, ids, bounds)
        rows = rows[good]
        if not len(rows):
            return numbers, groups, np.zeros(n + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[good])])
        flat = []
        for k, (table, ids, bounds) in enumerate(sides):
            numbers[k, rows] = np.diff(bounds)[good]
            ids = ids[np.repeat(good, np.diff(bounds))].astype(np.int64)
            ends = np.cumsum(table.sizes[ids])
            starts = ends - table.sizes[ids]
            flat.append((ids, starts, ends, starts[table.spaced[ids]]))
        # Both sides' tokens start with a space here; every text starts so.
        anchors = np.intersect1d(flat[0][3], flat[1][3], assume_unique=True)
        window = self.numbered(*(Side(ids, starts, ends, np.append(np.searchsorted(starts, anchors), len(ids))) for ids, starts, ends, _ in flat))
        own = self.windows
        bounds = np.searchsorted(anchors, offsets)
        for k, values in ((2, own.groups), (3, own.links)):
            numbers[k, rows] = np.add.reduceat(values[window], bounds[:-1])
        names = window.tolist()
        for row, (i, j) in zip(rows.tolist(), pairwise(bounds.tolist()), strict=True):
            groups[row] = ";".join([own.texts[w] for w in names[i:j]])
        counts = own.starts[window + 1] - own.starts[window]
        at = spread(own.starts[window], counts)
        owner = np.repeat(np.repeat(rows, np.diff(bounds)), counts)
        keys = owner << (2 * ID_BITS) | own.pairs[at]
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.add.reduceat(own.times[at[order]], first)
        keys = keys[first]
        edges = np.searchsorted(keys >> (2 * ID_BITS), np.arange(n + 1))
        return numbers, groups, edges, keys & ((1 << (2 * ID_BITS)) - 1), times

    def numbered(self, a: Side, b: Side) -> np.ndarray:
        """The number of each window of a slice among the remembered ones; new ones are aligned.

        Windows are told apart by a hash of their ids, and each is compared with the first of its hash.
        """
        own = self.windows
        if own.full():
            own.forget()
        hashes = np.zeros(len(a.cuts) - 1, np.uint64)
        for salt, side in ((1, a), (3, b)):
            power, inverse = powers(len(side.ids) + 1)
            sums = np.zeros(len(side.ids) + 1, np.uint64)
            np.cumsum(mixed(side.ids.astype(np.uint64) + np.uint64(salt)) * power[: len(side.ids)], out=sums[1:])
            cut = side.cuts
            hashes = mixed(hashes * np.uint64(5) + (sums[cut[1:]] - sums[cut[:-1]]) * inverse[cut[:-1]] + np.diff(cut).astype(np.uint64))
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        alike = np.ones(len(hashes), bool)
        for side in (a, b):
            sizes = np.diff(side.cuts)
            alike &= sizes == sizes[first][group]
            rows = np.flatnonzero(alike)
            (mine, sizes), (other, _) = side.of(rows), side.of(first[group[rows]])
            alike[np.repeat(rows, sizes)[side.ids[mine] != side.ids[other]]] = False
        odd = np.flatnonzero(~alike)  # equal hashes of different windows: each is aligned by itself
        group[odd] = len(first) + np.arange(len(odd))
        number = np.append(own.find(hashes[first], (a, b), first), np.full(len(odd), -1))
        first = np.append(first, odd)
        new = np.flatnonzero(number < 0)
        new = new[np.argsort(first[new])]
        if len(new):
            windows = first[new]
            at = np.searchsorted(own.keys, hashes[windows])
            keep = (new < len(number) - len(odd)) & (np.append(own.keys, 0)[at] != hashes[windows])
            number[new] = own.add(align(a, b, windows), hashes[windows], keep)
        return number[group]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker process's own aligner of two vocabulary files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def aligned(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = True) -> DataFrame:
    """Tokens of ``docs`` (``doc_id``, ``text``) by both vocabularies, aligned; a written table, a row for each row.

    Columns: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``; null
    without ``keep_groups``), groups_sha256, pairs (distinct ids linked, a << 20 | b), times. The first
    vocabulary is a byte-level one for ``tokenizers``, the second one for ``sentencepiece``; both encode the text after a space.

    Null and empty texts, and texts that either side's tokens do not spell byte for byte, have no tokens: zeros, empty
    groups and digest. Repeated rows and null ids are rows like any other; an empty table gives an empty result;
    other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, at = aligner(a_path, b_path), TaskContext.get().partitionId() << 36
        for batch, _ in sliced(batches, "text", SLICE_BYTES // 4):
            numbers, groups, edges, pairs, times = own.rows(batch.column(1).to_pylist())
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            edges = pa.array(edges, pa.int32())
            columns = [pa.array(at + np.arange(batch.num_rows)), batch.column(0), *map(pa.array, numbers), pa.array(groups if keep_groups else [None] * len(groups), pa.string()), pa.array(digests), pa.ListArray.from_arrays(edges, pa.array(pairs)), pa.ListArray.from_arrays(edges, pa.array(times))]
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "pairs", "times"])

    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pairs array<long>, times array<long>"
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """How many rows of :func:`aligned` hold each pair of ids linked: pair, a_id, b_id, n_docs, and best: no pair of its a_id has more."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    counts = materialise(counts.withColumn("a_id", F.shiftright("pair", ID_BITS)), "pairs")
    most = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(most, "a_id").select("pair", "a_id", F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b_id"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Of each row of ``docs`` its aligned tokens, and what its links count in all documents.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair no pair of the same first id exceeds
    in documents), count_sum (documents of each link's pair, summed over the links), groups_sha256. Odd rows: see :func:`aligned`.
    """
    rows = aligned(docs, a_path, b_path, keep_groups=False)
    counts = materialise(pair_counts(rows), "best")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if counts.count() > MOST_PAIRS:
        links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"), F.pmod("row", F.lit(SALTS)).alias("salt"))
        salted = counts.select("pair", "n_docs", "best", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        sums = links.join(salted, ["pair", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(F.lit(0))).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
        return rows.join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(out)
    table = counts.select("pair", "n_docs", "best").toPandas().sort_values("pair")
    shared = docs.sparkSession.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n_docs"].to_numpy(np.int64), table["best"].to_numpy(bool)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n_docs, best = shared.value
        for batch in batches:
            pairs, times = batch.column(6), batch.column(7)
            size = np.diff(pairs.offsets.to_numpy())
            at = np.searchsorted(names, pairs.flatten().to_numpy())
            times = times.flatten().to_numpy()
            owner = np.repeat(np.arange(len(size)), size)
            totals = [np.zeros(len(size), np.int64) for _ in range(2)]
            np.add.at(totals[0], owner, times * best[at])
            np.add.at(totals[1], owner, times * n_docs[at])
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *map(pa.array, totals), batch.column(5)], out)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.select(*out[:5], "groups_sha256", "pairs", "times").mapInArrow(look_up, schema)


def token_map(docs: DataFrame, a_path: str, b_path: str, share: float = 0.1) -> DataFrame:
    """The second vocabulary's ids for each id of the first: a_id, b_id, n_docs, share of all documents that its pairs count.

    Pairs under ``share`` are left out.
    """
    counts = pair_counts(aligned(docs, a_path, b_path, keep_groups=False))
    total = counts.groupBy("a_id").agg(F.sum("n_docs").alias("total"))
    return counts.join(total, "a_id").select("a_id", "b_id", "n_docs", (F.col("n_docs") / F.col("total")).alias("share")).where(F.col("share") >= share)
