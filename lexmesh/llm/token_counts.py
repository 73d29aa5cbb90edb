"""Token counts of fields and sections, from one encoding of each whole document.

A document is encoded once. Its tokens have character spans; sections (and fields, when a
document is several fields joined) have spans too. Spans are joined as sorted intervals, and
a token that crosses a boundary is allotted by a stated rule:

``start``   to the section that holds its first character,
``most``    to the section that holds most of its characters (the first of equals),
``share``   to each section by its part of the characters (counts are fractions).

Bytes of one character that fall to several tokens count as in the character's place: a token
spans from the character of its first byte to that of its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.packing import encoder, spread
from lexmesh.llm.textbytes import sliced

RULES = ("start", "most", "share")


def token_bytes(path: str) -> np.ndarray:
    """Bytes that each id of the vocabulary stands for."""
    vocab = encoder(path).tokenizer.get_vocab()
    special = encoder(path).special
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token.encode()) if token in special else len(token)
    return out


def spans(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character spans [start, end) of all tokens, in the joined texts, and each text's token range."""
    ids, bounds = encoder(path).encode(texts)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    # The character that each byte belongs to.
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(token_bytes(path)[ids])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return (char[starts], char[ends - 1] + 1, bounds) if len(ids) else (ids.astype(np.int64), ids.astype(np.int64), bounds)


def allotted(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each interval between neighbouring edges; the intervals cover all tokens."""
    n = len(edges) - 1
    first, last = np.searchsorted(edges, starts, "right") - 1, np.searchsorted(edges, ends - 1, "right") - 1
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float)
    out = np.bincount(first[first == last], minlength=n).astype(float)
    # Crossing tokens: their pieces, one for each interval they touch.
    cross = np.flatnonzero(first != last)
    count = last[cross] - first[cross] + 1
    owner, at = np.repeat(cross, count), spread(first[cross], count)
    part = np.minimum(ends[owner], edges[at + 1]) - np.maximum(starts[owner], edges[at])
    if rule == "share":
        return out + np.bincount(at, part / (ends[owner] - starts[owner]), n)
    order = np.lexsort((at, -part, owner))
    best = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] if len(order) else order
    return out + np.bincount(at[best], minlength=n)


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "start", separator: str = "\n") -> DataFrame:
    """Token counts of the sections of each text of ``docs`` (``doc_id``, ``text``).

    Sections are the stretches between separators (one character), each with the separator that ends it. Returns a row
    for each section: doc_id, section (from 0), start and length in characters, tokens (whole numbers
    but for rule ``share``). A document's counts add up to its number of tokens. Null and empty texts
    have one empty section without tokens; repeated rows are counted each; other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if len(separator) != 1:
        raise ValueError("separator must be one character")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = np.frombuffer(separator.encode("utf-32-le"), np.uint32)[0]
        for batch, _ in sliced(batches, "text"):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            # A section starts with each text, and after each separator that does not end its text.
            after = np.flatnonzero(points == mark) + 1
            after = after[~np.isin(after, offsets)]
            full = np.flatnonzero(sizes)
            starts = np.union1d(offsets[full], after)
            begin, end, _ = spans(texts, tokenizer)
            tokens = allotted(begin, end, np.append(starts, offsets[-1]), rule) if len(starts) else np.zeros(0)
            owner = np.searchsorted(offsets, starts, "right") - 1
            empty = np.flatnonzero(sizes == 0)
            owner, at = np.append(owner, empty), np.append(starts - offsets[owner], np.zeros(len(empty), np.int64))
            length, tokens = np.append(np.diff(np.append(starts, offsets[-1])), np.zeros(len(empty), np.int64)), np.append(tokens, np.zeros(len(empty)))
            order = np.lexsort((at, owner))
            owner, at, length, tokens = owner[order], at[order], length[order], tokens[order]
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            section = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *map(pa.array, (section, at, length, tokens))], ["doc_id", "section", "start", "length", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, section long, start long, length long, tokens double")


def count_field_tokens(docs: DataFrame, fields: list[str], tokenizer: str, rule: str = "start", joiner: str = "\n") -> DataFrame:
    """Token counts of the given fields, encoded as one text (joined by ``joiner``) for each row.

    Returns doc_id, field, tokens; the joiner belongs to the field before it, null fields are empty.
    Repeated rows and null ids are rows like any other, other columns are ignored, an empty table gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in sliced(batches, "text"):
            values = [[v or "" for v in batch.column(2 + i).to_pylist()] for i in range(len(fields))]
            rows = [[v + (joiner if i + 1 < len(fields) else "") for i, v in enumerate(row)] for row in zip(*values, strict=True)]
            begin, end, _ = spans(["".join(r) for r in rows], tokenizer)
            edges = np.concatenate([[0], np.cumsum([len(v) for r in rows for v in r])])
            real = np.flatnonzero(np.diff(edges))
            tokens = np.zeros(len(edges) - 1)
            if len(real):
                tokens[real] = allotted(begin, end, np.append(edges[real], edges[-1]), rule)
            owner = np.repeat(np.arange(batch.num_rows), len(fields))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(fields * batch.num_rows), pa.array(tokens)], ["doc_id", "field", "tokens"])

    own = docs.select("doc_id", F.concat_ws(joiner, *(F.col(f).cast("string") for f in fields)).alias("text"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    return own.mapInArrow(count, "doc_id long, field string, tokens double")
