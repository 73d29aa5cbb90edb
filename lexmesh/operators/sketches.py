"""Sketches of values by code, kept as columns and merged to wider groups without reading the values again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_sketches(df: DataFrame, value: str, *groups: Column | str, lg_k: int = 12, tracked: int = 10_000) -> DataFrame:
    """For each group the number of non-null values, a sketch of the distinct ones and one of the most frequent ones.

    Columns: the groups, n, distinct_sketch (2 ** ``lg_k`` registers at most), top_sketch (``tracked`` values at most). Their size is bounded
    however many values a group has, and tasks merge them before the shuffle. Null values count nowhere.
    """
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(value, lg_k).alias("distinct_sketch"), F.call_function("approx_top_k_accumulate", F.col(value), F.lit(tracked)).alias("top_sketch"))


def merged(sketches: DataFrame, *groups: Column | str) -> DataFrame:
    """The sketches of wider groups, from those of :func:`value_sketches`."""
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.call_function("approx_top_k_combine", F.col("top_sketch")).alias("top_sketch"))


def estimates(sketches: DataFrame, top: int = 5) -> DataFrame:
    """What the sketches say: n_distinct (relative standard error about 1.04 / 2 ** (lg_k / 2)) and top (item, count), the sketches left out.

    Counts of frequent values are exact as long as a group has at most 3/4 of ``tracked`` distinct ones, else upper bounds.
    """
    rest = [c for c in sketches.columns if not c.endswith("_sketch")]
    return sketches.select(*rest, F.hll_sketch_estimate("distinct_sketch").alias("n_distinct"), F.call_function("approx_top_k_estimate", F.col("top_sketch"), F.lit(top)).alias("top"))
