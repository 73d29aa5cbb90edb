"""Vector codes: a codebook for each part of a vector, found by rounds of nearest entries with adaptive bounds.

Components become integers, so every distance that decides is exact. Between rounds each part
of a vector keeps its entry with an upper bound of its distance, its b closest other entries with ordered
lower bounds, and one outer bound for all others. When the entries move, the bounds move by as much; a
part whose upper bound lies below the first lower bound stays without any distance. Otherwise the
distance to its own entry is worked out, then those to the listed entries whose bounds it does not
lie below, and only if it does not lie below the outer bound either, those to all entries. Bounds are floats
rounded to the safe side; whatever they leave open is decided by integers, ties by the lower index.

b follows what the last round needed of the lists, part by part. It changes the work, never the result.
Each round is one pass over a written table of vectors and bounds; only sums by part and entry are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.llm.shared import Scratch, written

#: Components that are worked on together, times entries.
CELLS = 4_000_000
#: A list is long enough if one part in so many needs more of it.
RARE = 100
#: Labels whose sums are broadcast (about 40 bytes each); more are joined by a shuffle, each in so many salted pieces.
MOST_LABELS, SALTS = 500_000, 32
_UP, _DOWN = 1 + 1e-6, 1 - 1e-6


def limit_of(width: int) -> int:
    """The largest component, so that squares summed over a whole vector stay in a long."""
    return 1 << int((62 - np.log2(max(width, 1))) / 2 - 1)


def above(x: np.ndarray) -> np.ndarray:
    return (np.sqrt(x.astype(np.float64)) * _UP).astype(np.float32)


def below(x: np.ndarray) -> np.ndarray:
    return (np.sqrt(x.astype(np.float64)) * _DOWN).astype(np.float32)


def all_squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None]


def squares(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    d = x - own
    return (d * d).sum(-1)


@dataclass
class Bounds:
    """Of one part of some vectors: entry, upper bound, listed entries, their lower bounds, outer bound."""

    entry: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    @staticmethod
    def row_bytes(b: int) -> int:
        return 1 + 4 + b + 4 * b + 4

    def pack(self) -> np.ndarray:
        columns = [self.entry[:, None].astype(np.uint8), self.near.astype(np.uint8)]
        floats = np.concatenate([self.upper[:, None], self.lower, self.outer[:, None]], 1).astype("<f4")
        return np.concatenate([*columns, np.ascontiguousarray(floats).view(np.uint8).reshape(len(floats), -1)], 1)

    @staticmethod
    def unpack(raw: np.ndarray, b: int) -> Bounds:
        floats = np.ascontiguousarray(raw[:, 1 + b :]).view("<f4")
        return Bounds(raw[:, 0].astype(np.int64), floats[:, 0].copy(), raw[:, 1 : 1 + b].astype(np.int64), floats[:, 1 : 1 + b].copy(), floats[:, 1 + b].copy())

    def resized(self, b: int) -> Bounds:
        """The list cut to b entries, or filled up with what the outer bound says."""
        own = self.near.shape[1]
        if b < own:
            return Bounds(self.entry, self.upper, self.near[:, :b], self.lower[:, :b], np.minimum(self.outer, self.lower[:, b]))
        more = b - own
        return Bounds(self.entry, self.upper, np.concatenate([self.near, np.repeat(self.entry[:, None], more, 1)], 1), np.concatenate([self.lower, np.repeat(self.outer[:, None], more, 1)], 1), self.outer)


def searched(x: np.ndarray, entries: np.ndarray, b: int) -> Bounds:
    """Bounds from the distances to all entries."""
    d = all_squares(x, entries)
    order = np.argsort(d, 1, kind="stable")  # ties: the lower index first
    d = np.take_along_axis(d, order, 1)
    outer = below(d[:, b + 1]) if b + 1 < len(entries) else np.full(len(x), np.inf, np.float32)
    found = Bounds(order[:, 0], above(d[:, 0]), order[:, 1 : b + 1], below(d[:, 1 : b + 1]), outer)
    return found if len(entries) > b else found.resized(b)


def moved(x: np.ndarray, at: Bounds, entries: np.ndarray, drift: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """Bounds after the entries have moved by ``drift``, and how many listed entries each row needed (one more: all entries)."""
    b = at.near.shape[1]
    entry, near = at.entry.copy(), at.near.copy()
    upper = ((at.upper + drift[entry]) * _UP).astype(np.float32)
    slack = np.float64(_DOWN)
    outer = (at.outer - drift.max(initial=0.0)) * np.where(at.outer > drift.max(initial=0.0), slack, 2 - slack)
    lower = at.lower - drift[near]
    lower *= np.where(lower > 0, slack, 2 - slack)
    # In order: whatever lies outside a listed entry is at least as far as its bound.
    ordered = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], 1)[:, ::-1], 1)[:, ::-1].astype(np.float32)
    lower, outer = ordered[:, :b].copy(), ordered[:, b].copy()

    def needed(rows: np.ndarray) -> np.ndarray:
        return (ordered[rows] <= upper[rows, None]).sum(1)

    open_ = np.flatnonzero(ordered[:, 0] <= upper)
    own = squares(x[open_], entries[entry[open_]])
    upper[open_] = above(own)
    need = np.zeros(len(x), np.int64)
    need[open_] = needed(open_)
    for m in range(1, b + 1):
        pick = need[open_] == m
        rows = open_[pick]
        if not len(rows):
            continue
        names = np.concatenate([entry[rows, None], near[rows, :m]], 1)
        d = np.concatenate([own[pick, None], squares(x[rows, None], entries[near[rows, :m]])], 1)
        order = np.lexsort((names, d), axis=1)
        names, d = np.take_along_axis(names, order, 1), np.take_along_axis(d, order, 1)
        entry[rows], upper[rows] = names[:, 0], above(d[:, 0])
        near[rows, :m], lower[rows, :m] = names[:, 1:], below(d[:, 1:])
    out = Bounds(entry, upper, near, lower, outer)
    rows = np.flatnonzero(need > b)
    if len(rows):
        new = searched(x[rows], entries, b)
        for name in ("entry", "upper", "near", "lower", "outer"):
            getattr(out, name)[rows] = getattr(new, name)
    return out, need


@dataclass
class Codebooks:
    """Entries by part, entry and position; and, round by round, how many parts needed 0, 1, ... listed entries."""

    entries: np.ndarray
    lists: list[int]
    needs: list[np.ndarray] = field(default_factory=list)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(column: pa.Array, width: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * x), limited so that squared distances stay in a long."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    limit = limit_of(width)
    return np.clip(np.floor(x * scale), -limit, limit).astype(np.int64)


def rows_of(column: pa.Array, kind: str) -> np.ndarray:
    """A column of equally long binary values as a matrix."""
    n = len(column)
    _, offsets, data = column.buffers()
    first, last = np.frombuffer(offsets, np.int32 if pa.types.is_binary(column.type) else np.int64)[[column.offset, column.offset + n]]
    return np.frombuffer(data, np.uint8)[first:last].view(kind).reshape(n, -1)


def binaries(matrix: np.ndarray) -> pa.Array:
    n, size = matrix.shape[0], matrix.itemsize * matrix.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(matrix))])


def parts_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
        pa.default_memory_pool().release_unused()


def kept_rows(vectors: DataFrame, label: str | None) -> DataFrame:
    """Rows whose vector has finite components only, as vec_id, embedding, label."""
    kind = vectors.schema["embedding"].dataType
    plain = isinstance(getattr(kind, "elementType", None), T.FloatType | T.DoubleType)
    v = F.col("embedding") if plain else F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"))


def codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, label: str | None = "label") -> tuple[DataFrame, Codebooks]:
    """Codes of all rows of ``vectors`` (``vec_id``, ``embedding``, ``label``), and the codebooks.

    The table has vec_id, label, code (two hex digits for each part) and error (squared distances summed over the
    parts). The codebooks start as the parts of the first ``entries`` kept rows by vec_id (nulls last, ties by
    the vector); fewer rows make smaller codebooks. An entry that no part has stays; others become the floor of
    their parts' mean.

    Null vectors, empty ones and those with null or non-finite components are dropped. So are vectors of another
    length than that of the first kept row, which has to be a multiple of ``parts``, else ValueError. Components
    beyond :func:`limit_of` (2 ** 27 for 64 of them: x of 32,768) count as it. Repeated rows and ids are
    coded once each; an empty table gives an empty result; other columns are ignored. Sums by part and entry
    (16 * length numbers) go through the driver.
    """
    spark = vectors.sparkSession
    if not 0 < entries <= 255:
        raise ValueError("codes: entries must be 1 to 255")
    kept = kept_rows(vectors, label)
    order = [F.col("vec_id").asc_nulls_last(), "embedding"]
    first = kept.orderBy(*order).limit(entries).collect()
    schema = T.StructType([T.StructField("vec_id", T.LongType()), kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        return spark.createDataFrame([], schema), Codebooks(np.zeros((parts, 0, 0), np.int64), [0] * parts)
    width = len(first[0].embedding)
    if width % parts:
        raise ValueError(f"codes: vectors of {width} components have no {parts} equal parts")
    kept = kept.where(F.size("embedding") == width)
    if any(len(r.embedding) != width for r in first):
        first = kept.orderBy(*order).limit(entries).collect()
    d, count = width // parts, len(first)
    start = integers(pa.array([r.embedding for r in first], pa.list_(pa.float64())), width, scale)
    books = Codebooks(start.reshape(count, parts, d).transpose(1, 0, 2).copy(), [max(1, count // 4)] * parts)
    scratch = Scratch(spark)
    step = max(1, CELLS // (width * count))

    def assign(old: Codebooks | None, new: Codebooks, source: DataFrame, final: bool) -> DataFrame:
        """One pass over the rows: bounds for ``new`` from those for ``old``, and each task's sums; or the codes."""
        now, lists = new.entries, new.lists
        before = old.lists if old else None
        drift = np.sqrt(((now - old.entries).astype(np.float64) ** 2).sum(2)) * _UP if old else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros((parts, count, d), np.int64), np.zeros((parts, count), np.int64)
            needs = np.zeros((parts, count + 1), np.int64)
            label_type = None
            for batch in parts_of(batches, step):
                if not batch.num_rows:
                    continue
                x = integers(batch.column(1), width, scale) if before is None else rows_of(batch.column(1), "<i4").astype(np.int64)
                state = None if before is None else rows_of(batch.column(3), "u1")
                label_type = batch.column(2).type
                out, at, errors, code = [], 0, np.zeros(len(x), np.int64), []
                for p in range(parts):
                    own = np.ascontiguousarray(x[:, p * d : (p + 1) * d])
                    if state is None:
                        found, need = searched(own, now[p], lists[p]), np.full(len(x), count)
                    else:
                        size = Bounds.row_bytes(before[p])
                        found, need = moved(own, Bounds.unpack(state[:, at : at + size], before[p]), now[p], drift[p])
                        at += size
                    needs[p] += np.bincount(np.minimum(need, count), minlength=count + 1)
                    if final:
                        errors += squares(own, now[p][found.entry])
                        code.append(found.entry)
                        continue
                    out.append(found.resized(lists[p]).pack())
                    for j in range(count):
                        members = own[found.entry == j]
                        counts[p, j] += len(members)
                        sums[p, j] += members.sum(0)
                if final:
                    digits = np.frombuffer(b"".join(b"%02x" % i for i in range(256)), np.uint8).reshape(256, 2)
                    text = digits[np.stack(code, 1)].reshape(len(x), -1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), binaries(text).cast(pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), binaries(x.astype("<i4")), batch.column(2), binaries(np.concatenate(out, 1)), pa.nulls(len(x), pa.list_(pa.int64()))], columns)
            if label_type is not None and not final:
                totals = np.concatenate([sums.ravel(), counts.ravel(), needs.ravel()])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, label_type), pa.nulls(1, pa.binary()), pa.array([totals], pa.list_(pa.int64()))], columns)

        columns = ["vec_id", "x", "label", "bounds", "totals"]
        if final:
            return source.mapInArrow(run, schema)
        return scratch.write(source.mapInArrow(run, T.StructType([schema["vec_id"], T.StructField("x", T.BinaryType()), schema["label"], T.StructField("bounds", T.BinaryType()), T.StructField("totals", T.ArrayType(T.LongType()))])), "bounds")

    old, table, last = None, kept, None
    for _ in range(rounds):
        done = assign(old, books, table, False)
        scratch.drop(last)
        totals = np.zeros(parts * (count * (d + 1) + count + 1), np.int64)
        for r in done.where("totals IS NOT NULL").select(F.posexplode("totals").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).where("n <> 0").collect():
            totals[r.i] = r.n
        sums, counts, needs = np.split(totals, [parts * count * d, parts * count * (d + 1)])
        sums, counts, needs = sums.reshape(parts, count, d), counts.reshape(parts, count), needs.reshape(parts, count + 1)
        means = np.where(counts[..., None] > 0, sums // np.maximum(counts[..., None], 1), books.entries)
        old = books
        books = Codebooks(means, lengths(old.lists, needs) if old.needs else old.lists, [*old.needs, needs])
        last = done
        table = done.where("totals IS NULL").select("vec_id", "x", "label", "bounds")
    out, _ = written(assign(old, books, table, True), "codes")
    scratch.clear()
    return out, books


def lengths(lists: list[int], needs: np.ndarray) -> list[int]:
    """The next lengths of the lists: the shortest that all but few parts did with, within an eighth and half of the entries."""
    count = needs.shape[1] - 1
    out = []
    for b, seen in zip(lists, needs, strict=True):
        more = seen.sum() - np.cumsum(seen)  # how many needed more than 0, 1, ... listed entries
        rare = seen.sum() // RARE
        enough = next((i for i in range(1, b + 1) if more[i] <= rare), b + 2)
        out.append(min(max(enough, count // 8, 1), max(count // 2, 1)))
    return out


def code_vectors(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """:func:`codes` with the error summed over the rows of equal label (nulls together) and the codebooks' digest.

    Returns vec_id, code, error, label_error, codebooks_sha256. Up to MOST_LABELS labels are counted and then
    broadcast; more are joined by a shuffle, in which a label that many rows have is dealt over SALTS tasks.
    """
    table, books = codes(vectors, parts, entries, rounds, scale)
    sums = table.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("of_label"))
    if sums.count() <= MOST_LABELS:
        joined = table.join(F.broadcast(sums), same)
    else:
        salted = table.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)))
        copies = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(copies, same & (F.col("salt") == F.col("of_salt")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same rounds in SQL, one statement for each: all distances to all entries."""
    sql = f"""
WITH k AS (
  SELECT vec_id, label, [floor(x::DOUBLE * {scale})::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, i // (len(v) // {parts}) AS part, i % (len(v) // {parts}) AS pos, v[i + 1] AS v FROM (SELECT *, unnest(range(len(v))) AS i FROM k)
), c0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part, pos ORDER BY vec_id) - 1 AS entry, pos, v FROM x QUALIFY entry < {entries}
)"""
    for r in range(rounds + 1):
        sql += f""", a{r} AS MATERIALIZED (
  SELECT vec_id, part, min(({{'d': d, 'entry': entry}})) AS best
  FROM (SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL) GROUP BY ALL
)"""
        if r < rounds:
            sql += f""", c{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT x.part, a.best.entry AS entry, x.pos, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN a{r} a ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL
  ) m ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos
)"""
    return sql + f""", e AS (
  SELECT vec_id, string_agg(lpad(printf('%x', best.entry), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT e.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM e JOIN k ON e.vec_id = k.vec_id"""
