"""Exact Jaccard join of word-shingle sets, with skipping by set relations; classes of linked documents.

1. Each document's distinct shingles are hashed. Chunks of documents send them, packed by
   hash range, to the range's task, which sends back those that two different sets share. A
   shingle of one set alone links nothing, so what comes back is all that the join needs.
2. Shingles are ordered rarest first. By the prefix filter a set that links has a shared
   shingle in the first n - ceil(0.75 n) + 1; sets without one are done.
3. In the index each list is cut into blocks by set size, with the bounds of the positions in
   the sets. A probe skips whole blocks that sizes and positions rule out.
4. Set relations: in a few rounds every set is compared with one leader of its lists, and sets
   that link become classes. Candidates within a class need no comparison. A set keeps its best
   leader, the overlap with it, and the number of its shingles that the leader lacks. What a set
   can share with a third one follows from its leader's answer for that one: the overlap of the
   two leaders and those lacking shingles bound it. Only pairs of different classes that this
   bound leaves open are compared, so no link between classes is lost.

Sets that are equal are one node throughout. Hashes have 64 bits (shingles) and 128 bits (sets);
whether two sets of one shingle differ is told by 64 bits of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.chunks import from_planes, planes
from lexmesh.llm.shared import Scratch, free_prefix, materialise, partitions, without
from lexmesh.llm.textbytes import SLICE_BYTES, mixed, shingles, sliced

#: A shingle that so many sets of a chunk have is asked for once, beside a list of the sets.
MANY = 32
_MANY = 0xFFFF
#: Bytes of text for each hash range.
RANGE_BYTES = 16_000_000
_FLOW = "range int, chunk long, kind int, a binary, b binary, c binary"
_NAMES = ["range", "chunk", "kind", "a", "b", "c"]


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _NAMES)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit signatures of the sets, as rows of two 64-bit values."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, s in enumerate(sets):
        out[i] = (np.sum(mixed(s + np.uint64(77))), np.sum(mixed(s ^ np.uint64(0x5851F42D4C957F2D))))
        out[i] += np.uint64(len(s))
    return mixed(out)


def questions(k: int, ranges: int):
    """Map side: documents to rows for the hash ranges (kind 0), lists of sets (1) and documents (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        cuts = np.array([(i << 64) // ranges for i in range(ranges)], np.uint64)
        # With many ranges slices grow, so that a row keeps some hundred shingles.
        for batch, texts in sliced(batches, "text", min(max(SLICE_BYTES // 2, 300 * ranges), 8 * SLICE_BYTES)):
            sets = shingles(texts, k)
            chunk, number = (part << 32) + number, number + 1
            sig = signatures(sets)
            n = np.array([len(s) for s in sets], np.int64)
            ids = batch.column(0)
            valid = np.array(ids.is_valid().to_pylist(), bool)
            rows = [(chunk % ranges, chunk, 2, ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), n.astype("<i8").tobytes(), sig.astype("<u8").tobytes() + valid.tobytes())]
            # Equal sets of a chunk ask once.
            _, one = np.unique(sig, axis=0, return_index=True)
            one = one[n[one] > 0]
            if len(one):
                hashes = np.concatenate([sets[i] for i in one])
                owner = np.repeat(one, n[one])
                order = np.argsort(hashes, kind="stable")
                hashes, owner = hashes[order], owner[order]
                first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                count = np.diff(np.append(first, len(hashes)))
                heavy = np.repeat(count >= MANY, count)
                if heavy.any():
                    rows.append((chunk % ranges, chunk, 1, planes(hashes[first[count >= MANY]]), owner[heavy].astype("<u2").tobytes(), count[count >= MANY].astype("<u4").tobytes()))
                    keep = ~heavy
                    keep[first] = True
                    owner = np.where(heavy, _MANY, owner)
                    hashes, owner = hashes[keep], owner[keep]
                edges = [*np.searchsorted(hashes, cuts).tolist(), len(hashes)]
                for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False)):
                    if x < y:
                        own = np.unique(owner[x:y])
                        rows.append((i, chunk, 0, planes(hashes[x:y]), owner[x:y].astype("<u2").tobytes(), sig[own[own != _MANY], 0].astype("<u8").tobytes()))
            yield batch_of(rows)

    return run


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: of each range the shingles that different sets share, with their counts."""
    ranges: dict[int, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2]:
                yield batch_of([row])
            else:
                ranges.setdefault(row[0], []).append(row)
    for key in sorted(ranges):
        rows = ranges.pop(key)
        hashes = [from_planes(r[3]) for r in rows]
        owners = [np.frombuffer(r[4], "<u2") for r in rows]
        tag, many = np.concatenate([tags_of(o, np.frombuffer(r[5], "<u8")) for r, o in zip(rows, owners, strict=True)]), np.concatenate(owners) == _MANY
        joined = np.concatenate(hashes)
        order = np.argsort(joined, kind="stable")
        ordered, tag, many = joined[order], tag[order], many[order]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        size = np.diff(np.append(first, len(ordered)))
        # A list of a chunk counts as MANY; equal sets of other chunks count again, which moves only the order.
        weight = np.add.reduceat(np.where(many, MANY, 1), first)
        shared = np.logical_or.reduceat(many, first) | (np.maximum.reduceat(tag, first) != np.minimum.reduceat(tag, first))
        total = np.empty(len(joined), np.int64)
        total[order] = np.repeat(np.where(shared, np.maximum(weight, 2), 0), size)
        at = 0
        for row, own, owner in zip(rows, hashes, owners, strict=True):
            mine = total[at : at + len(own)]
            at += len(own)
            keep = mine > 0
            if keep.any():
                yield batch_of([(key, row[1], 0, planes(own[keep]), owner[keep].tobytes(), np.minimum(mine[keep], (1 << 32) - 1).astype("<u4").tobytes())])
    # The worker lives on through other stages, without what Arrow keeps of these batches.
    pa.default_memory_pool().release_unused()


def tags_of(owners: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """The tag of each owner: ``tags`` are those of the distinct owners in order; 0 for lists."""
    if not len(tags):
        return np.zeros(len(owners), np.uint64)
    own = np.unique(owners)
    return tags[np.minimum(np.searchsorted(own, owners), len(tags) - 1)]


def prefix_size(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def cores(table: pa.Table) -> pa.Table:
    """The shared shingles, rarest first, of those sets of one chunk whose prefix has one."""
    lists: dict[int, np.ndarray] = {}
    found, sizes = [], None
    for kind, a, b, c in zip(*(table.column(i).to_pylist() for i in ("kind", "a", "b", "c")), strict=True):
        if kind == 0:
            found.append((from_planes(a), np.frombuffer(b, "<u2").astype(np.int64), np.frombuffer(c, "<u4")))
        elif kind == 1:
            own = np.split(np.frombuffer(b, "<u2").astype(np.int64), np.cumsum(np.frombuffer(c, "<u4"))[:-1])
            lists = dict(zip(from_planes(a).tolist(), own, strict=True))
        else:
            sizes, sig = np.frombuffer(b, "<i8"), np.frombuffer(c[: 2 * len(b)], np.uint8).reshape(-1, 16)
    out: list[tuple] = []
    if found and sizes is not None:
        hashes, owner, total = (np.concatenate([f[i] for f in found]) for i in range(3))
        for i in np.flatnonzero(owner == _MANY):
            members = lists[int(hashes[i])]
            found.append((np.full(len(members), hashes[i]), members, np.full(len(members), total[i], np.uint32)))
        if len(lists):
            hashes, owner, total = (np.concatenate([f[i] for f in found]) for i in range(3))
            on = owner != _MANY
            hashes, owner, total = hashes[on], owner[on], total[on]
        order = np.lexsort((hashes, total, owner))
        hashes, owner = hashes[order], owner[order]
        docs, first = np.unique(owner, return_index=True)
        for d, x, y in zip(docs.tolist(), first.tolist(), [*first[1:].tolist(), len(owner)], strict=True):
            n, single = int(sizes[d]), int(sizes[d]) - (y - x)
            if single < prefix_size(n):
                out.append((sig[d].tobytes(), n, single, hashes[x:y].astype("<u8").tobytes()))
    return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.binary()))], ["node", "n", "single", "core"])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of the packed document rows: doc_id, n, node."""
    for batch in batches:
        for a, b, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            n = len(b) // 8
            valid = np.frombuffer(c[16 * n :], bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8"), mask=~valid), pa.array(np.frombuffer(b, "<i8")), pa.array([c[16 * i : 16 * i + 16] for i in range(n)], pa.binary())], ["doc_id", "n_shingles", "node"])


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries: token, node, n, single, pos and rest (shared shingles before and after it), prev (the token before)."""
    for batch in batches:
        for row in range(batch.num_rows):
            node, n, single = (batch.column(i)[row].as_py() for i in range(3))
            core = np.frombuffer(batch.column(3)[row].as_buffer(), "<i8")
            tokens = core[: prefix_size(n) - single]
            m = len(tokens)
            prev = pa.array(np.concatenate([tokens[:1], tokens[:-1]]), mask=np.arange(m) == 0)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array([node] * m, pa.binary()), pa.array([n] * m), pa.array([single] * m), pa.array(np.arange(m)), pa.array(len(core) - 1 - np.arange(m)), prev], ["token", "node", "n", "single", "pos", "rest", "prev"])


def may_link(n: Column, pos: Column, rest: Column, m: Column, other_pos: Column, other_rest: Column) -> Column:
    """Sets of n and m shingles that share a token may reach a Jaccard similarity of 0.75.

    Only shared shingles can be common: at most the fewer before the token, itself, and the fewer after.
    """
    most = F.least(pos, other_pos) + 1 + F.least(rest, other_rest)
    return (7 * most >= 3 * (n + m)) & (4 * F.least(n, m) >= 3 * F.greatest(n, m))


def overlaps(pairs: DataFrame, core: DataFrame, tables: Scratch, few: int = 500_000) -> DataFrame:
    """Exact answers of pairs (a, b) of nodes: a, b, overlap, na, nb, linked.

    Up to ``few`` pairs (of 32 bytes each) are counted and then broadcast to the sets, of which only those
    of a pair are shuffled; more pairs are joined by shuffles.
    """
    a, b = (core.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("core").alias("core_" + x)) for x in "ab")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                both = np.concatenate([np.frombuffer(v.as_buffer(), "<u8") for v in (x, y)])
                both.sort()
                found.append(int(np.count_nonzero(both[1:] == both[:-1])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(found, pa.int64())], ["a", "b", "na", "nb", "overlap"])

    pairs = tables.write(pairs, "asked")
    if pairs.count() <= few:
        asked = F.broadcast(pairs)
        both = a.join(asked, "a").join(b.join(asked, "b"), ["a", "b"])
    else:
        both = pairs.join(a, "a").join(b, "b")
    joined = both.select("a", "b", "na", "nb", "core_a", "core_b").mapInArrow(count, "a binary, b binary, na long, nb long, overlap long")
    return joined.withColumn("linked", 7 * F.col("overlap") >= 3 * (F.col("na") + F.col("nb")))


def components(links: DataFrame, tables: Scratch) -> DataFrame:
    """(node, label): the least node that links (a, b) reach, for each node that has a link.

    Each round takes the least label of the neighbours and then the label's own label, so
    chains shorten by half; every round is a written table, which takes the place of the one before.
    """
    both = tables.write(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = tables.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        # Only labels that stand for themselves no more change anything.
        jump = labels.where("label != node").select(F.col("node").alias("to"), F.col("label").alias("further"))
        after = lower.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("label"), (F.least("to", F.coalesce("further", "to")) != F.col("was")).alias("moved"))
        after = tables.write(after, "labels")
        tables.drop(labels)
        labels = after
        if labels.where("moved").isEmpty():
            tables.drop(both)
            return labels


def size_class() -> Column:
    """Classes of set sizes: sets that link are in one class or in neighbouring ones."""
    return F.floor(F.log(F.col("n").cast("double")) / float(np.log(4 / 3)) + 1e-9)


def led_round(entries: DataFrame, core: DataFrame, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """One leader for each list, and the comparison of each set with the first leader of its lists.

    The leader is the list's first free set with the smallest share of shingles of its own; a set is
    compared with one leader of another class, so a round makes one pair for each set at most.
    Returns the entries of those lists that hold several classes, with the leader, and the pairs (a: the leader).
    """
    key = F.struct("rank", F.col("node").alias("leader"), F.col("n").alias("leader_n"), F.col("pos").alias("leader_pos"), F.col("rest").alias("leader_rest"), F.col("label").alias("leader_label"))
    lists = entries.groupBy("token").agg(F.min(F.when(F.col("free"), key)).alias("lead"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token", "lead")
    mixed = tables.write(entries.join(lists, "token"), "mixed")
    near = mixed.select("node", "n", "pos", "rest", "label", "lead.*").where((F.col("label") != F.col("leader_label")) & may_link(F.col("n"), F.col("pos"), F.col("rest"), F.col("leader_n"), F.col("leader_pos"), F.col("leader_rest")))
    chosen = near.groupBy("node").agg(F.min(F.struct("rank", "leader")).alias("first")).select(F.col("first.leader").alias("a"), F.col("node").alias("b"))
    return mixed, tables.write(overlaps(chosen, core, tables), "met")


def linked_nodes(core: DataFrame, tables: Scratch, rounds: int = 3) -> DataFrame:
    """(node, label) of all nodes of ``core`` that link with another."""
    spread = core.mapInArrow(prefixes, "token long, node binary, n long, single long, pos long, rest long, prev long")
    sizes = core.select("node", "n", (F.octet_length("core") / 8).cast("long").alias("size"))
    # Each set's class as far as known, and whether it may still lead.
    state = sizes.select("node", F.col("node").alias("label"), F.lit(True).alias("free"))
    entries = spread.withColumn("rank", (F.col("single") * 1000 / F.col("n")).cast("int")).drop("single").withColumn("label", F.col("node")).withColumn("free", F.lit(True))
    entries = tables.write(entries, "entries")
    met = core.sparkSession.createDataFrame([], "a binary, b binary, na long, nb long, overlap long, linked boolean")
    for _ in range(rounds):
        mixed, now = led_round(entries, core, tables)
        tables.drop(entries)
        entries = mixed.drop("lead")
        if now.isEmpty():
            break
        met = met.unionByName(now)
        led = now.where("linked").select(F.col("b").alias("node"), F.col("a").alias("by"))
        used = mixed.select(F.col("lead.leader").alias("node")).where("node IS NOT NULL").distinct().withColumn("used", F.lit(True))
        after = state.join(led, "node", "left").join(used, "node", "left")
        state = tables.write(after.select("node", F.coalesce("by", "label").alias("label"), (F.col("free") & F.col("by").isNull() & F.col("used").isNull()).alias("free")), "state")
        entries = tables.write(entries.drop("label", "free").join(state, "node"), "entries")
        tables.drop(mixed)
    met = tables.write(met, "met")
    labels = components(met.where("linked"), tables)
    # The leader that shares most with a set; sets that lead others they link with lead themselves.
    heads = met.where("linked").select(F.col("a").alias("node")).distinct()
    best = met.groupBy(F.col("b").alias("node")).agg(F.max_by(F.struct(F.col("a").alias("leader"), "overlap"), F.struct("overlap", "a")).alias("best"))
    state = sizes.join(labels.select("node", "label"), "node", "left").join(best.join(heads, "node", "left_anti"), "node", "left")
    state = state.select("node", "n", F.coalesce("label", "node").alias("label"), F.coalesce("best.leader", "node").alias("leader"), F.coalesce("best.overlap", "size").alias("common"), (F.col("size") - F.coalesce("best.overlap", "size")).alias("extra"))
    own = state.select(F.col("node").alias("leader"), F.col("label").alias("leader_label"))
    state = tables.write(state.join(own, "leader").withColumn("inner", F.col("label") == F.col("leader_label")).drop("leader_label"), "state")
    more = links_between(entries, state, in_order(met.select("a", "b", "overlap")), core, tables)
    if more.isEmpty():
        return labels.select("node", "label")
    # Further links join classes: their labels are the nodes of a second, small graph.
    return state.join(merged(more, tables), "label", "left").select("node", F.coalesce("final", "label").alias("label"))


def merged(links: DataFrame, tables: Scratch) -> DataFrame:
    """(label, final) of the labels that links (la, lb) between classes join."""
    return components(links.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), tables).select(F.col("node").alias("label"), F.col("label").alias("final"))


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(c for c in pairs.columns if c not in ("a", "b")))


def list_blocks(entries: DataFrame) -> DataFrame:
    """Blocks of the lists: the entries of one size class and one leader, those of its class (inner) apart from others.

    With the bounds of sizes, places and of what the sets share with their leader and have beside it.
    """
    return entries.groupBy("token", "size_class", "leader", "inner").agg(
        F.min("n").alias("low_n"), F.max("n").alias("high_n"), F.max("rest").alias("high_rest"),
        F.max("common").alias("high_common"), F.max("extra").alias("high_extra"), F.min("label").alias("low"), F.max("label").alias("high"),
    )


def enough(most: Column, n: Column, m: Column) -> Column:
    """Sets of n and m shingles that share ``most`` may link."""
    return 7 * most >= 3 * (n + m)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of one list that may hold sets of different classes that link.

    Each probing block (p\\_) reads the blocks of its own size class and of the next. Sets of one
    leader share no more than the fewer have in common with it, and the fewer beside it.
    """
    columns = [c for c in blocks.columns if c not in ("token", "size_class")]
    twice = blocks.withColumn("p_class", F.col("size_class")).withColumn("size_class", F.explode(F.array(F.col("size_class"), F.col("size_class") + 1)))
    probes = twice.select("token", "size_class", "p_class", *(F.col(c).alias("p_" + c) for c in columns))
    once = (F.col("p_class") < F.col("size_class")) | (F.struct("p_leader", "p_inner") <= F.struct("leader", "inner"))
    differ = ~((F.col("low") == F.col("high")) & (F.col("p_low") == F.col("p_high")) & (F.col("low") == F.col("p_low")))
    # The first token that two sets share leaves them those after it, so they meet there or may not link.
    places = 1 + F.least("high_rest", "p_high_rest")
    sizes = (4 * F.col("high_n") >= 3 * F.col("p_low_n")) & (4 * F.col("p_high_n") >= 3 * F.col("low_n"))
    relation = (F.col("leader") != F.col("p_leader")) | enough(F.least("high_common", "p_high_common") + F.least("high_extra", "p_high_extra"), F.col("low_n"), F.col("p_low_n"))
    met = blocks.join(probes, ["token", "size_class"]).where(once & differ & sizes & enough(places, F.col("low_n"), F.col("p_low_n")) & relation)
    return met.select("token", "size_class", "p_class", "leader", "inner", "p_leader", "p_inner")


def links_between(entries: DataFrame, state: DataFrame, met: DataFrame, core: DataFrame, tables: Scratch) -> DataFrame:
    """Links between classes of ``state``, as pairs (la, lb) of their labels: all that the leaders' answers do not rule out."""
    e = entries.drop("rank", "n", "label", "free").join(state, "node").withColumn("size_class", size_class())
    several = e.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token")
    e = tables.write(e.join(several, "token"), "between")
    blocks = tables.write(block_pairs(list_blocks(e)), "blocks")
    ends = blocks.where("leader != p_leader").select(F.least("p_leader", "leader").alias("a"), F.greatest("p_leader", "leader").alias("b")).distinct()
    answers = ends.join(met.groupBy("a", "b").agg(F.max("overlap").alias("overlap")), ["a", "b"], "left")
    answers = tables.write(answers, "answers")
    fresh = tables.write(overlaps(answers.where("overlap IS NULL").select("a", "b"), core, tables), "fresh")
    # Leaders that link join their classes, which need not be opened for one another any more.
    of = state.select(F.col("node").alias("a"), F.col("label").alias("la"))
    labelled = fresh.where("linked").join(of, "a").join(of.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b").where("la != lb").select("la", "lb")
    found = tables.write(labelled, "links")
    known = answers.where("overlap IS NOT NULL").unionByName(fresh.select("a", "b", "overlap"))
    if not found.isEmpty():
        e = e.join(merged(found, tables), "label", "left").withColumn("label", F.coalesce("final", "label")).drop("final")
        e = tables.write(e, "between")
        state = state.join(merged(found, tables), "label", "left").withColumn("label", F.coalesce("final", "label")).drop("final")
    opened = opened_blocks(blocks, state, known)
    more = overlaps(set_pairs(e, opened, in_order(met)), core, tables).where("linked").join(of, "a").join(of.select(F.col("a").alias("b"), F.col("la").alias("lb")), "b").select("la", "lb")
    return tables.write(found.unionByName(more), "more")


def opened_blocks(blocks: DataFrame, state: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs of blocks that the groups' bounds leave open; the probing one (p\\_) is that of fewer sets."""
    groups = state.groupBy("leader", "inner").agg(F.min("n").alias("low_n"), F.max("extra").alias("high_extra"), F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("sets"))
    p_groups = groups.select(*(F.col(c).alias("p_" + c) for c in groups.columns))
    ends = blocks.select("leader", "inner", "p_leader", "p_inner").distinct()
    ends = ends.withColumn("a", F.least("p_leader", "leader")).withColumn("b", F.greatest("p_leader", "leader")).join(known, ["a", "b"], "left").drop("a", "b")
    ends = ends.join(groups, ["leader", "inner"]).join(p_groups, ["p_leader", "p_inner"])
    differ = ~((F.col("low") == F.col("high")) & (F.col("p_low") == F.col("p_high")) & (F.col("low") == F.col("p_low")))
    ends = ends.where(differ & ((F.col("leader") == F.col("p_leader")) | enough(F.col("overlap") + F.col("high_extra") + F.col("p_high_extra"), F.col("low_n"), F.col("p_low_n"))))
    found = blocks.join(ends, ["leader", "inner", "p_leader", "p_inner"])
    turn = F.col("p_sets") > F.col("sets")
    pairs = [("size_class", "p_class"), *((c, "p_" + c) for c in ("leader", "inner", "low_n", "high_extra"))]
    turned = [F.when(turn, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in pairs] + [F.when(turn, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in pairs]
    return found.select("token", "overlap", *turned)


def set_pairs(e: DataFrame, opened: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different classes in opened blocks that may link, but for those in ``met``."""
    p = e.select("token", *(F.col(c).alias("p_" + c) for c in ("node", "n", "rest", "prev", "label", "leader", "inner", "common", "extra")), F.col("size_class").alias("p_class"))
    same = F.col("leader") == F.col("p_leader")
    # Probing sets that may link with none of the other group go no further.
    group_n = F.greatest("low_n", F.ceil(F.col("p_n") * 3 / 4))
    most = F.when(same, F.col("p_common") + F.least("p_extra", "high_extra")).otherwise(F.col("overlap") + F.col("p_extra") + F.col("high_extra"))
    probes = opened.drop("p_low_n", "p_high_extra").join(p, ["token", "p_class", "p_leader", "p_inner"]).where(enough(most, F.col("p_n"), group_n))
    probes = probes.select("token", "size_class", "leader", "inner", "overlap", *(c for c in p.columns if c not in ("token", "p_class", "p_inner")))
    bound = F.when(same, F.least("common", "p_common") + F.least("extra", "p_extra")).otherwise(F.col("overlap") + F.col("extra") + F.col("p_extra"))
    apart = (F.col("label") != F.col("p_label")) & ~F.coalesce(F.col("prev") == F.col("p_prev"), F.lit(False))
    # At the first token that two sets share, those after it decide; later ones need not meet their pair again.
    open_ = apart & enough(F.least(bound, 1 + F.least("rest", "p_rest")), F.col("n"), F.col("p_n")) & (4 * F.least("n", "p_n") >= 3 * F.greatest("n", "p_n"))
    pairs = probes.join(e, ["token", "size_class", "leader", "inner"]).where(open_)
    return pairs.select(F.least("node", "p_node").alias("a"), F.greatest("node", "p_node").alias("b")).distinct().join(met, ["a", "b"], "left_anti")


def classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """Classes of documents linked by shingle sets of Jaccard similarity 0.75 or more.

    ``docs`` has doc_id and text. Returns doc_id, n_shingles, component_id for every row: the
    smallest id that the row's links reach. Equal sets link; texts with fewer than ``k`` words have one
    shingle; null texts and texts without words have none and link with nothing. Repeated rows are rows
    like any other; a null id is kept but is never a class's smallest; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    tables = Scratch(spark)
    # Ranges follow the size of the texts, so that no task grows with them.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * partitions(spark), -(-size // RANGE_BYTES))
    asked = docs.select("doc_id", "text").mapInArrow(questions(k, ranges), _FLOW)
    flow = tables.write(asked.repartition(ranges, "range").mapInArrow(answers, _FLOW), "shared")
    core = flow.groupBy("chunk").applyInArrow(cores, "node binary, n long, single long, core binary")
    core = tables.write(core.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "single", "core"))), "cores")
    rows = materialise(flow.where("kind = 2").select("a", "b", "c").mapInArrow(unpacked, "doc_id long, n_shingles long, node binary"), "rows")
    tables.drop(flow)
    labels = linked_nodes(core, tables)
    least = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = materialise(least.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "nodes")
    tables.clear()
    of_label = joined.groupBy("label").agg(F.min("least").alias("component"))
    of_node = joined.join(of_label, "label").select(F.col("node").alias("r_node"), "component")
    return rows.join(of_node, (F.col("node") == F.col("r_node")) & (F.col("n_shingles") > 0), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i : i + 4], ' ') END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared_n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id != b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared_n >= 75 * (nx.n + ny.n - shared_n)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(y) FROM reach WHERE x = w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id)
"""


def deduplicate(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of ``docs`` but for those whose class (see :func:`classes`) has a smaller id; all columns.

    Rows without shingles stay, as do null ids. An id that is repeated stays if any of its rows does,
    and of its rows those that are equal in all columns stay once.
    """
    found = materialise(classes(docs, k).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("rows")), "classes")
    left = without(docs, found.where("NOT stays").select("doc_id"))
    own = free_prefix(docs, "__join_")
    repeated = found.where("stays AND rows > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(own + "id"))
    if repeated.isEmpty():
        return left
    again = F.col("doc_id") == F.col(own + "id")
    return left.join(repeated, again, "left_anti").unionByName(left.join(repeated, again, "left_semi").dropDuplicates())
