"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies (target words over
the source's words). Within a source the documents stand in order of size, then of a
hash of the id; the expected copies are summed up along that order, one random offset
is added for the whole source, and a document is emitted once for each integer that
its stretch of the running sum crosses. The order by size makes the sample stratified,
so the words taken differ from the target by about the size of one document.

The running sum is never formed in one task: counts by (source, size, hash bucket) give
the start of each cell, and only the rows of one cell are numbered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmesh.llm.shared import WORD, free_prefix, materialise


def source_targets(sizes: DataFrame, weights: Sequence[int], factor: float, cap: int) -> DataFrame:
    """Targets from one row per source (``source``, ``source_size``).

    Sources in code point order (null last) get the weights in turn. They share ``factor``
    times all words by weight; none gets over ``cap`` times its own words, and what it
    cannot take is shared among the others by weight. An empty source has target 0.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    filled = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(ranked) - 1) % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * cap
    # Sources fill up in order of limit / weight; the level is the first that is not reached.
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(factor)) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    levels = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("limit", limit)
        .withColumn("fill", F.col("limit") / F.col("weight"))
        .withColumn("level", left / F.sum("weight").over(after))
        .withColumn("open_fill", F.when(F.col("weight") * F.col("level") < F.col("limit"), F.col("fill")))
        .withColumn("first_fill", F.min("open_fill").over(everything))
        .withColumn("final", F.max(F.when(F.col("open_fill") == F.col("first_fill"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("final").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("weight") * F.col("final")))
    return levels.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), factor: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """Copies of each row of ``docs`` (``doc_id``, ``source``, ``text``) in the mix.

    Returns doc_id, source, size, source_size, target, copies, taken. Null text has size 0;
    null sources form a source of their own; repeated rows and ids are rows like any other
    (equal rows are interchangeable); texts without words always get the copies their place
    in the order gives, which take no words; an empty table gives an empty result. Other
    columns are ignored.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = materialise(docs.select("doc_id", "source", words.alias("size"), key.alias("place")), "mix")
    rows = rows.withColumn("cell", F.substring("place", 1, 3))
    cells = rows.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    strata = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    targets = source_targets(strata.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, factor, cap)
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("source", "size", F.coalesce(F.sum("n").over(below), F.lit(0)).alias("stratum_start"))
    earlier = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("cell_start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    starts, strata, targets = (x.alias(a) for x, a in ((starts, "c"), (strata, "s"), (targets, "t")))
    starts = (
        starts.join(strata, F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.size") == F.col("s.size")))
        .join(targets, F.col("c.source").eqNullSafe(F.col("t.source")))
        .select(F.col("c.source").alias("source_"), F.col("c.size").alias("size_"), F.col("c.cell").alias("cell_"), (F.col("cell_start") + F.col("stratum_start")).alias("start"), "source_size", "target")
    )
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("place", "doc_id")))
    placed = numbered.join(starts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")) & (F.col("cell") == F.col("cell_")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    position = F.col("rank") + F.col("start")
    copies = F.floor(position * F.col("rate") + F.col("offset")) - F.floor((position - 1) * F.col("rate") + F.col("offset"))
    return (
        placed.withColumn("rate", rate)
        .withColumn("offset", offset)
        .withColumn("copies", copies.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def repeat(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), factor: float = 1.5, cap: int = 2, seed: str = "mix") -> DataFrame:
    """The rows of ``docs``, each as often as :func:`mix` takes it, with all their columns.

    Rows that are equal in id, source and size share the copies that they get together evenly; which of
    them get one more is told by a hash of the text.
    """
    groups = mix(docs, weights, factor, cap, seed).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies")).where("copies > 0")
    own = free_prefix(docs, "__mix_")
    key = ["doc_id", "source", "size"]
    groups = materialise(groups.select(*(F.col(c).alias(own + c) for c in (*key, "rows", "copies"))), "copies")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col(own + "doc_id")) & F.col("source").eqNullSafe(F.col(own + "source")) & (words == F.col(own + "size"))

    def emitted(rows: DataFrame, copies: Column) -> DataFrame:
        return rows.withColumn(own + "copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(docs.columns)

    one = groups.where(F.col(own + "rows") == 1)
    # A shuffle of the texts at every size: the copies grow with the table and are never broadcast.
    out = emitted(docs.join(one.hint("merge"), same), F.col(own + "copies"))
    several = groups.where(F.col(own + "rows") > 1)
    if several.isEmpty():
        return out
    # Rows of a group are numbered partition by partition, so that no task holds a large group.
    rows = materialise(docs.join(several.hint("merge"), same).withColumn(own + "part", F.spark_partition_id()).withColumn(own + "hash", F.xxhash64("text")), "repeated")
    group = [F.struct(*(F.col(own + c) for c in key)).alias(own + "group"), F.col(own + "part")]
    before = Window.partitionBy(own + "group").orderBy(own + "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).withColumn(own + "start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.select(F.col(own + "group").alias(own + "of_group"), F.col(own + "part").alias(own + "of_part"), own + "start")
    placed = rows.select("*", group[0]).join(starts, (F.col(own + "group") == F.col(own + "of_group")) & (F.col(own + "part") == F.col(own + "of_part")))
    number = F.row_number().over(Window.partitionBy(own + "group", own + "part").orderBy(own + "hash")) + F.col(own + "start")
    total, count = F.col(own + "copies"), F.col(own + "rows")
    return out.unionByName(emitted(placed.withColumn(own + "number", number), F.floor(total / count) + (F.col(own + "number") <= total % count).cast("int")))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS place
  FROM documents
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2 AS lim FROM src
), f AS (
  SELECT *, lim / weight AS fill FROM w
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM f
), o AS (
  SELECT *, CASE WHEN weight * level < lim THEN fill END AS open_fill FROM l
), z AS (
  SELECT (SELECT max(level) FROM o WHERE open_fill = (SELECT min(open_fill) FROM o)) AS final
), t AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN lim::DOUBLE ELSE least(lim::DOUBLE, weight * final) END AS target,
    ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM o, z
), r AS (
  SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END::DOUBLE AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY size, place, doc_id) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(pos * rate + u) - floor((pos - 1) * rate + u)))::BIGINT AS taken FROM r
"""
