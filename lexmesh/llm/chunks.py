"""Documents packed into chunk rows, and counts of hashed items over all chunks.

A chunk is one row with some thousand documents. Counting works by question and answer:
each chunk sends the distinct hashes of its items, packed by hash range, to the range's
task, which adds the counts up and answers each chunk with the hashes' totals. A hash that
every document has costs one entry for each chunk, and no task sees more of a range than that.

What a task holds does not grow with the tables or with the tasks: chunks are written in small row
groups, there are as many ranges as the texts ask for, ranges are worked on one after the other, and the answers
come to a chunk in a sorted stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.shared import materialise, partitions
from lexmesh.llm.textbytes import SLICE_BYTES, sliced

#: Texts of which one range of hashes is counted at once, if the partitions are too few for less.
RANGE_BYTES = 16_000_000
#: Parquet's sizes for rows of some MB: without them 100 rows at least are held, by the writer and then by the reader.
FEW_ROWS = {"parquet.block.size": "2097152", "parquet.page.size": "2097152", "parquet.page.size.row.check.min": "1"}


def chunked(docs: DataFrame) -> DataFrame:
    """Rows (chunk, doc_ids, texts) of about 2 MB of text, written to the shared folder."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch, _ in sliced(batches, "text"):
            n = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + k]), *(pa.ListArray.from_arrays(n, batch.column(i)) for i in (0, 1))], ["chunk", "doc_ids", "texts"])
            k += 1

    return materialise(docs.select("doc_id", "text").mapInArrow(pack, "chunk long, doc_ids array<long>, texts array<string>"), "chunks", FEW_ROWS)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; memory that Arrow keeps of one goes back before the next, as workers live on through other stages."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def planes(hashes: np.ndarray) -> bytes:
    """Sorted 64-bit values as byte planes, which compress better."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view(">u8").reshape(-1).astype(np.uint64)


def counted(chunks: DataFrame, ask: Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray]], least: int, kinds: int = 1) -> DataFrame:
    """Rows (chunk, hashes, totals): of each chunk's hashes those whose total is ``least`` or more.

    ``ask(doc_ids, texts)`` gives a chunk's sorted distinct hashes and their counts (int64). Rows of
    chunk -1 hold, for each kind (hash modulo ``kinds``), the sum of totals and the number of distinct
    hashes with a total, of one range of hashes.
    """
    spark = chunks.sparkSession
    ranges = max(partitions(spark), -(-chunks.count() * SLICE_BYTES // RANGE_BYTES))

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for row in range(batch.num_rows):
                hashes, counts = ask(batch.column(1)[row].values, batch.column(2)[row].values)
                edges = np.searchsorted(hashes, np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)).tolist() + [len(hashes)]
                out = [(i, planes(hashes[a:b]), counts[a:b].astype("<u4").tobytes()) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
                if out:
                    chunk = [batch.column(0)[row].as_py()] * len(out)
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array(chunk, pa.int64()), *(pa.array([o[i] for o in out], pa.binary()) for i in (1, 2))], ["range", "chunk", "hashes", "counts"])

    asked = chunks.mapInArrow(questions, "range int, chunk long, hashes binary, counts binary")
    asked = asked.repartition(ranges, F.col("range")).sortWithinPartitions("range")
    return asked.mapInArrow(lambda batches: answers(batches, least, kinds), "chunk long, hashes binary, totals binary")


def answers(batches: Iterator[pa.RecordBatch], least: int, kinds: int) -> Iterator[pa.RecordBatch]:
    """Totals for the questions (range, chunk, hashes, counts), which come sorted by range: one range is held at a time."""
    rows = ((r, c, from_planes(h), np.frombuffer(n, "<u4")) for b in released(batches) for r, c, h, n in zip(*(x.to_pylist() for x in b.columns), strict=True))
    for _, group in groupby(rows, lambda row: row[0]):
        own = list(group)
        joined = np.concatenate([x[2] for x in own])
        order = np.argsort(joined, kind="stable")
        ordered = joined[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        sums = np.add.reduceat(np.concatenate([x[3] for x in own]).astype(np.int64)[order], np.flatnonzero(first))
        totals = np.empty(len(joined), np.int64)
        totals[order] = sums[np.cumsum(first) - 1]
        firsts, kept = np.flatnonzero(first), sums > 0
        kind = (ordered[firsts] % np.uint64(kinds)).astype(np.int64)
        summary = np.stack([np.bincount(kind, sums, kinds), np.bincount(kind[kept], minlength=kinds)]).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([b""], pa.binary()), pa.array([summary.tobytes()], pa.binary())], ["chunk", "hashes", "totals"])
        del joined, order, ordered, first, firsts
        begin = 0
        for _, chunk, hashes, _ in own:
            mine = totals[begin : begin + len(hashes)]
            begin += len(hashes)
            keep = mine >= least
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([planes(hashes[keep])], pa.binary()), pa.array([mine[keep].astype("<i8").tobytes()], pa.binary())], ["chunk", "hashes", "totals"])


def answered(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """The answers (hashes, totals) of each chunk and then the chunk itself (doc_ids, texts), next to each other in one task."""
    texts = chunks.select("chunk", F.lit(True).alias("whole"), "doc_ids", "texts", F.lit(None).cast("binary").alias("hashes"), F.lit(None).cast("binary").alias("totals"))
    found = answers.where("chunk >= 0").select("chunk", F.lit(False).alias("whole"), F.lit(None).cast("array<long>").alias("doc_ids"), F.lit(None).cast("array<string>").alias("texts"), "hashes", "totals")
    return texts.unionByName(found).repartition("chunk").sortWithinPartitions("chunk", "whole")


def with_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """doc_ids, texts, sorted hashes and their totals of each chunk of :func:`answered`."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in released(batches):
        whole = batch.column(1).to_pylist()
        for row, last in enumerate(whole):
            if not last:
                parts.append((from_planes(batch.column(4)[row].as_buffer()), np.frombuffer(batch.column(5)[row].as_py(), "<i8")))
                continue
            hashes = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)])
            totals = np.concatenate([np.zeros(0, np.int64), *(t for _, t in parts)])
            parts = []
            order = np.argsort(hashes)
            yield batch.column(2)[row].values, batch.column(3)[row].values, hashes[order], totals[order]


def summed(df: DataFrame, dtype: type = np.float32) -> DataFrame:
    """Sums of vectors of ``dtype`` by key: ``df`` has rows (key int, vector binary), few keys."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in released(batches):
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(vector.as_buffer(), dtype)
                sums[key] = sums[key] + own if key in sums else own.astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(dtype).tobytes() for v in sums.values()], pa.binary())], ["key", "vector"])

    return df.repartition(partitions(df.sparkSession), "key").mapInArrow(add, "key int, vector binary")


def looked_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 if it is not there."""
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)
