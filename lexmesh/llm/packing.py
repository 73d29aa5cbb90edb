"""Mixture-controlled packing: deficit round-robin over source queues into token windows.

Every source is a queue of its documents' tokens. In each round a queue is served its
quantum, its target share of a window's tokens; the fraction that a round cannot serve is
its deficit and is carried to the next one. The served stretches follow one another and are
cut into windows, so all windows but the last are full and each holds the target mixture.

What a queue has been served after any number of rounds has a closed form, so where a token
goes follows from its place in its queue alone. Tasks need only the totals of the sources and
the place where each block of documents starts, and each carries on from the deficits that
the tasks before it leave: no task walks a whole queue.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator, Mapping
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmesh.llm.shared import materialise
from lexmesh.llm.textbytes import SLICE_BYTES, mixed, powers, sliced

#: Shares of a round are whole multiples of 2 ** -SHIFT tokens.
SHIFT = 16
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)


def kinds() -> np.ndarray:
    """Kinds of the code points under U+0250; control characters are odd."""
    out = np.full(0x251, _OTHER, np.uint8)
    for i in range(0x250):
        c = unicodedata.category(chr(i))
        out[i] = _LETTER if c[0] == "L" else _DIGIT if c[0] == "N" else _ODD if c == "Cc" else _SPACE if c == "Zs" else _OTHER
    out[[9, 10, 11, 12, 13]] = _SPACE
    out[0x250] = _ODD
    return out


class Encoder:
    """Token ids of texts by a byte-level BPE vocabulary, whole batches at a time.

    A text is cut into the vocabulary's pre-tokens by numpy rules over the kinds of its
    characters; each distinct pre-token is encoded once and remembered. Texts with control
    characters, characters from U+0250 on or a special token are encoded whole.
    """

    REMEMBERED = 300_000
    #: What the fast encoder and ``tokenizers`` must agree on before the vocabulary file is used.
    PROBE = "The children's naïve questions, 1234567 of them,  weren't\n\n\tanswered! Straße über-all <a_b> internationalisation"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        # The vocabulary's merges stand in order of the ids, so the ids are the ranks of a faster encoder.
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in letters} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters)}
        ranks = {bytes(letters[c] for c in token): i for token, i in self.tokenizer.get_vocab().items() if token not in self.special}
        self.one = tiktoken.Encoding("ranks", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.kinds = kinds()
        self.forget()
        self.values = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 0x251, np.uint64) | np.uint64(1)
        if not np.array_equal(self.encode([self.PROBE])[0], self.whole([self.PROBE])[0]):
            raise ValueError(f"{path}: its pre-tokens, normaliser or order of merges are not those this encoder knows")

    def forget(self) -> None:
        self.keys, self.starts, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the start of each text's ids (and the end)."""
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        kind = self.kinds[np.minimum(points, 0x250)]
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(offsets, np.flatnonzero(kind == _ODD), "right") - 1] = True
        for special in self.special:
            odd |= np.fromiter((special in t for t in texts), bool, len(texts))
        starts = self.cuts(points, kind, offsets)
        ends = np.append(starts[1:], len(points))
        ids, per_piece = self.of_pieces(points, starts, ends)
        piece_at = np.searchsorted(starts, offsets)
        bounds = np.concatenate([[0], np.cumsum(per_piece)])[piece_at]
        if odd.any():
            parts = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
            rows = np.flatnonzero(odd)
            for i, own in zip(rows, self.whole([texts[i] for i in rows]), strict=True):
                parts[i] = own
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds

    def cuts(self, points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the pre-tokens start: runs of letters, digits, others or blanks.

        A single space joins the run after it; a blank run gives up its last blank to what
        follows, as its own piece if that blank is no space; an apostrophe that opens a run takes
        the letters of an English contraction with it.
        """
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        opens = np.zeros(n + 1, bool)
        opens[offsets] = True
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= opens[:n]
        space = kind == _SPACE
        # The last blank of a run that the same text goes on after.
        last = np.zeros(n, bool)
        last[:-1] = space[:-1] & ~space[1:] & ~opens[1:n]
        start |= last
        joins = np.flatnonzero(last & (points == 32)) + 1
        start[joins] = False
        # Contractions: an apostrophe at the start of a piece.
        at = np.flatnonzero(start & (points == 39))
        if len(at):
            limit = offsets[np.searchsorted(offsets, at, "right")]
            padded = np.concatenate([points, np.zeros(3, np.uint32)])
            a, b = padded[at + 1], padded[at + 2]
            one = (limit - at > 1) & np.isin(a, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            two = (limit - at > 2) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            for rows, k in ((at[one], 2), (at[two & ~one], 3)):
                start[rows + 1] = False
                end = rows + k
                inside = end < n
                start[end[inside]] = True
        return np.flatnonzero(start)

    def of_pieces(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        power, inverse = powers(len(points) + 1)
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(self.values[np.minimum(points, 0x250)] * power[: len(points)], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        order = np.argsort(hashes)
        ordered = hashes[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        distinct, first = ordered[new], order[new]
        inverse_of = np.empty(len(order), np.int64)
        inverse_of[order] = np.cumsum(new) - 1
        if len(self.keys) + len(distinct) > self.REMEMBERED:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        missing = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if missing.any():
            self.remember(distinct[missing], [points[starts[i] : ends[i]].tobytes().decode("utf-32-le") for i in first[missing]])
            place = np.searchsorted(self.keys, distinct)
        piece = place[inverse_of]
        count = self.starts[piece + 1] - self.starts[piece]
        return self.ids[spread(self.starts[piece], count)], count

    def remember(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pre-tokens and keep their ids in order of key."""
        found = [self.one(p) for p in pieces]
        counts = np.concatenate([np.diff(self.starts), np.fromiter(map(len, found), np.int64, len(found))])
        starts = np.concatenate([[0], np.cumsum(counts)])
        ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32)])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys)
        self.ids = ids[spread(starts[:-1][order], counts[order])]
        self.keys, self.starts = keys[order], np.concatenate([[0], np.cumsum(counts[order])])


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker process's own encoder of a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Schedule:
    """Where the tokens of each queue go: the closed form of deficit round-robin.

    After r rounds a queue of ``total`` tokens with quantum q has been served min(total, floor(r q)).
    """

    def __init__(self, totals: list[int], shares: list[float], window: int):
        self.totals, self.window = np.array(totals, np.int64), window
        whole = window << SHIFT
        scale = sum(shares) or 1.0
        self.quanta = np.maximum(np.array([int(s / scale * whole) for s in shares], np.int64), 1)

    def served(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        return np.minimum((rounds * self.quanta[queue]) >> SHIFT, self.totals[queue])

    def round_of(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        return -((-(tokens + 1) << SHIFT) // self.quanta[queue]) - 1

    def place(self, queue: int, tokens: np.ndarray) -> np.ndarray:
        """The place in the packed stream of tokens of a queue."""
        rounds, back = np.unique(self.round_of(queue, tokens), return_inverse=True)
        before = np.zeros(len(rounds), np.int64)
        for i in range(len(self.totals)):
            before += self.served(i, rounds + (i < queue))
        return (before - self.served(queue, rounds))[back] + tokens

    def cuts(self, queue: int, begin: int, end: int) -> np.ndarray:
        """The first token of each stretch of [begin, end) that is served in one round and window."""
        first, last = self.round_of(queue, np.array([begin, end - 1]))
        if last - first < end - begin:
            own = self.served(queue, np.arange(first + 1, last + 1))
            cuts = np.unique(np.concatenate([[begin], own[(own > begin) & (own < end)]]))
        else:
            cuts = np.arange(begin, end)
        room = self.window - self.place(queue, cuts) % self.window
        sizes = np.diff(np.append(cuts, end))
        more = [cuts]
        while (over := sizes > room).any():
            cuts, sizes = cuts[over] + room[over], sizes[over] - room[over]
            room = np.full(len(cuts), self.window)
            more.append(cuts)
        return np.sort(np.concatenate(more))


def tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Ids of the documents by block (a slice of a partition) and source, with their place in the partition's queue."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, own, block = TaskContext.get().partitionId(), encoder(path), 0
        begun: dict[str | None, int] = {}
        for batch, _ in sliced(batches, "text", SLICE_BYTES // 4):
            ids, bounds = own.encode([t or "" for t in batch.column(2).to_pylist()])
            sources, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            rows: dict[str | None, list[int]] = {}
            for i, s in enumerate(sources):
                rows.setdefault(s, []).append(i)
            end = np.array([end_id], np.uint32)
            out = []
            for s, members in rows.items():
                joined = np.concatenate([x for i in members for x in (ids[bounds[i] : bounds[i + 1]], end)]).astype("<u4")
                out.append((part, block, s, begun.get(s, 0), len(joined), [names[i] for i in members], [int(bounds[i + 1] - bounds[i]) + 1 for i in members], joined.tobytes()))
                begun[s] = begun.get(s, 0) + len(joined)
            block += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], columns)

    columns = ["part", "block", "source", "begun", "tokens", "doc_ids", "sizes", "ids"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(encode, "part int, block long, source string, begun long, tokens long, doc_ids array<long>, sizes array<int>, ids binary")


def pack(docs: DataFrame, tokenizer: str, targets: Mapping[str | None, float] | None = None, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack all rows of ``docs`` (``doc_id``, ``source``, ``text``) into sequences of ``window`` tokens.

    ``targets`` gives relative shares of the sources (others: none of them may be missing); by default
    each source's share is its share of all tokens, so the queues run dry together. A queue that is
    dry leaves the rounds, and the others fill the windows. Returns a row for each piece: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset, source.

    Null and empty texts are the end id alone; a null source is a source of its own; repeated rows
    are packed once each; an empty table gives an empty result; other columns are ignored.
    The driver holds one total for each source; sources are the mixture's components.
    """
    tokens = materialise(tokenised(docs, tokenizer, end_id), "tokens")
    parts = tokens.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialise(parts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))), "queues")
    queues = parts.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    names, totals = [q["source"] for q in queues], [q["n"] for q in queues]
    schedule = Schedule(totals, [float(n if targets is None else targets[s]) for s, n in zip(names, totals, strict=True)], window)
    queue_of = {s: i for i, s in enumerate(names)}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                source, begin, doc_ids, sizes, ids = (batch.column(i)[row] for i in range(5))
                source, begin, queue = source.as_py(), begin.as_py(), queue_of[source.as_py()]
                doc_ids, sizes = doc_ids.values, sizes.values.to_numpy().astype(np.int64)
                ids = memoryview(ids.as_buffer())
                end = begin + len(ids) // 4
                edges = begin + np.concatenate([[0], np.cumsum(sizes)])
                cuts = np.union1d(schedule.cuts(queue, begin, end), edges[:-1])
                places = schedule.place(queue, cuts)
                owner = np.searchsorted(edges, cuts, "right") - 1
                bounds = (np.append(cuts, end) - begin) * 4
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [doc_ids.take(pa.array(owner)), cuts - edges[owner], np.diff(np.append(cuts, end)), np.array(crcs, np.int64), sizes[owner], places // window, places % window]
                yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), pa.array([source] * len(cuts), pa.string())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    p = parts.select(F.col("source").alias("p_source"), F.col("part").alias("p_part"), "first")
    placed = tokens.join(p, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part"))).select("source", (F.col("first") + F.col("begun")).alias("begin"), "doc_ids", "sizes", "ids")
    return placed.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string")
