"""A sparse graph of values that share codes, instead of all pairs of each block."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmesh.scratch import written

#: What a code counts that one right value has; one that n have counts this divided by n, rounded down.
WHOLE = 1_000_000


def block_graph(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keys: Callable[[Column], Column], finer: Sequence[Callable[[Column], Column]] = (), most: int = 50, keep: int = 3) -> DataFrame:
    """Each left value's heaviest edges to right values with which it shares codes: left_value, right_value, n_codes, weight.

    ``keys`` gives the codes of a value as an array; equal ones count once. A code that more than ``most`` distinct right values
    have is split by the first function of ``finer`` (values then share it only if they agree there too), what
    is still too common by the next one, and at last by the value itself. An edge weighs the sum, over the codes
    shared, of WHOLE div the number of right values that have it. A left value keeps its ``keep`` heaviest
    edges and all that weigh as much as the last of them.

    A left value meets at most ``most`` right ones by each of its codes, so the result is linear in the
    values, however common a code is. Nulls share nothing; repeated values count once; empty sides give an empty result.
    """

    def coded(df: DataFrame, on: str) -> DataFrame:
        distinct = df.select(F.col(on).cast("string").alias("value")).where("value IS NOT NULL").distinct()
        return distinct.select("value", F.explode(F.array_distinct(keys(F.col("value")))).alias("code")).where("code IS NOT NULL")

    a, b = coded(left, left_on), coded(right, right_on)
    done = []
    for finest in (False,) * len(finer) + (True,):
        counts = b.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
        rare = counts.where(F.col("n") <= most)
        done.append((a, b.join(rare, "code")))
        common = written(counts.where(F.col("n") > most).select("code"), "common")
        if common.isEmpty():
            break
        part = F.col("value") if finest else finer[len(done) - 1](F.col("value")).cast("string")
        a, b = (x.join(common, "code", "left_semi").select("value", F.concat_ws("\x1f", "code", part).alias("code")) for x in (a, b))
    else:
        done.append((a, b.join(b.groupBy("code").agg(F.count(F.lit(1)).alias("n")), "code")))
    pairs = [x.withColumnRenamed("value", "left_value").join(y.select("code", F.col("value").alias("right_value"), F.floor(F.lit(WHOLE) / F.col("n")).alias("weight")), "code") for x, y in done]
    edges = reduce(DataFrame.unionByName, pairs).groupBy("left_value", "right_value").agg(F.count(F.lit(1)).alias("n_codes"), F.sum("weight").alias("weight"))
    heaviest = Window.partitionBy("left_value").orderBy(F.col("weight").desc())
    return edges.withColumn("rank", F.rank().over(heaviest)).where(F.col("rank") <= keep).drop("rank")
