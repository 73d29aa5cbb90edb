"""Block, compare, pick: joins on strings that are alike.

Values are compared once each: both sides are reduced to their distinct values, blocked by
keys, joined on the keys alone (an equi-join, so Spark shuffles or broadcasts by size), and
compared with a bounded native distance; the pairs of values then join back to the rows. A
value that a third of the rows have is one value in all of this.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmesh.functions import damerau_levenshtein, double_metaphone, levenshtein, soundex
from lexmesh.functions.distance import damerau_possible
from lexmesh.operators.segments import near_values, values_of

Keys = Callable[[Column], Column]
#: Given as keys: the index of segments, which holds for any distance and for long values.
SEGMENTS = "segments"


def soundex_keys(value: Column) -> Column:
    return F.array(soundex(value))


def metaphone_keys(value: Column) -> Column:
    """Values share a block if any of their codes is equal."""
    return double_metaphone(value)


def deletion_keys(k: int) -> Keys:
    """Keys under which all values within distance k (0 to 2; Levenshtein or Damerau) meet: k deletions at most."""
    if k not in (0, 1, 2):
        raise ValueError("deletion_keys: k must be 0, 1 or 2")

    def shorter(value: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.char_length(value), F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substring(value, F.lit(1), i - 1), F.substring(value, i + 1, F.lit(1_000_000_000))))

    def keys(value: Column) -> Column:
        out = F.array(value)
        last = out
        for _ in range(k):
            last = F.array_distinct(F.flatten(F.transform(last, shorter)))
            out = F.array_distinct(F.concat(out, last))
        return out

    return keys


def _values(df: DataFrame, on: str, name: str, keys: Keys) -> DataFrame:
    distinct = df.select(F.col(on).alias(name)).where(F.col(name).isNotNull()).distinct()
    return distinct.select(name, F.explode(keys(F.col(name))).alias("key"))


def block_pairs(left: DataFrame, right: DataFrame, left_on: str, right_on: str, keys: Keys, condition: Column | None = None) -> DataFrame:
    """Distinct pairs (left_value, right_value) of values that share a key.

    ``condition`` is a native test on the two, checked within the join. Nulls pair with nothing.
    """
    a, b = _values(left, left_on, "left_value", keys), _values(right, right_on, "right_value", keys)
    on = a["key"] == b["key"]
    return a.join(b, on if condition is None else on & condition).select("left_value", "right_value").distinct()


def _close(left: DataFrame, right: DataFrame, left_on: str, right_on: str, k: int, keys: Keys | str | None, metric: str) -> DataFrame:
    if metric not in ("levenshtein", "damerau"):
        raise ValueError("metric must be 'levenshtein' or 'damerau'")
    if keys == SEGMENTS or (keys is None and k > 2):
        return near_values(values_of(left, left_on), values_of(right, right_on), k, metric)
    # An edit costs either side one deletion at most; a transposition too: of the character that changes places.
    keys = keys or deletion_keys(k)
    if metric == "levenshtein":
        pairs = block_pairs(left, right, left_on, right_on, keys, levenshtein("left_value", "right_value", k) <= k)
        return pairs.withColumn("distance", levenshtein("left_value", "right_value", k))
    pairs = block_pairs(left, right, left_on, right_on, keys, damerau_possible("left_value", "right_value", k))
    return pairs.withColumn("distance", damerau_levenshtein("left_value", "right_value", k)).where(F.col("distance") <= k)


def fuzzy_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, max_distance: int, keys: Keys | str | None = None, metric: str = "levenshtein") -> DataFrame:
    """Rows of both sides whose values are within ``max_distance``, with the ``distance``.

    Without ``keys`` the join is exact: up to 2 by deletions, which suits words, beyond by an index of segments, which
    ``SEGMENTS`` chooses for small distances of long values too. Keys such as :func:`soundex_keys` restrict it to
    pairs of one block. Column names of the sides must differ.
    """
    near = _close(left, right, left_on, right_on, max_distance, keys, metric)
    return left.join(near, left[left_on] == near["left_value"]).join(right, near["right_value"] == right[right_on]).select(*left.columns, *right.columns, "distance")


def fuzzy_semi(left: DataFrame, right: DataFrame, left_on: str, right_on: str, max_distance: int, keys: Keys | str | None = None, metric: str = "levenshtein") -> DataFrame:
    """Rows of the left side that have a near value on the right."""
    near = _close(left, right, left_on, right_on, max_distance, keys, metric).select("left_value").distinct()
    return left.join(near, left[left_on] == near["left_value"], "left_semi")


def fuzzy_anti(left: DataFrame, right: DataFrame, left_on: str, right_on: str, max_distance: int, keys: Keys | str | None = None, metric: str = "levenshtein") -> DataFrame:
    """Rows of the left side that have none; null values have none."""
    near = _close(left, right, left_on, right_on, max_distance, keys, metric).select("left_value").distinct()
    return left.join(near, left[left_on] == near["left_value"], "left_anti")


def best_match(left: DataFrame, right: DataFrame, left_on: str, right_on: str, max_distance: int, keys: Keys) -> DataFrame:
    """For each distinct left value its nearest right value of the block (then the first): one row each.

    The nearest is kept by an aggregate that combines before the shuffle, not by sorting each block.
    """
    near = _close(left, right, left_on, right_on, max_distance, keys, "levenshtein")
    best = near.groupBy("left_value").agg(F.min(F.struct("distance", "right_value")).alias("best"))
    return best.select("left_value", F.col("best.right_value").alias("right_value"), F.col("best.distance").alias("distance"))


def ranked_matches(left: DataFrame, right: DataFrame, left_on: str, right_on: str, max_distance: int, keys: Keys, top: int) -> DataFrame:
    """The ``top`` nearest right values of each left value, with their ``rank``."""
    near = _close(left, right, left_on, right_on, max_distance, keys, "levenshtein")
    order = Window.partitionBy("left_value").orderBy("distance", "right_value")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
