"""As-of join: for each row the last row of another table with its key, up to its time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_time: str, right_time: str, width: int = 86_400) -> DataFrame:
    """All rows of ``left`` with the columns of the last row of ``right`` whose key is equal and whose time is not later.

    Of right rows of one key and time the greatest counts, its columns compared in their order. Rows
    without one, and those with a null key or time, have nulls; right rows with a null key or time count
    nowhere; repeated rows are rows like any other; an empty right side gives nulls. Column names of the sides must differ.

    Both sides are put in order within stretches of ``width`` seconds of a key, so a key that very many
    rows have is dealt over its stretches; what a stretch starts with is carried over from one row for each stretch before it.
    """
    taken = F.lit(None).cast(right.schema)

    def rows(df: DataFrame, key: str, time: str, own: bool) -> DataFrame:
        known = df.where(F.col(key).isNotNull() & F.col(time).isNotNull())
        bucket = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / width)
        whole = F.struct(*df.columns)
        return known.select(F.col(key).alias("key"), bucket.alias("bucket"), F.col(time).alias("time"), (whole if own else F.lit(None).cast(left.schema)).alias("l"), (taken if own else whole).alias("r"))

    both = rows(left, left_key, left_time, True).unionByName(rows(right, right_key, right_time, False))
    # Right rows of a time come before left ones, the greatest last.
    order = Window.partitionBy("key", "bucket").orderBy("time", F.col("l").isNotNull(), "r").rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("found", F.last("r", True).over(order)).where("l IS NOT NULL")
    ends = both.groupBy("key", "bucket").agg(F.max(F.when(F.col("r").isNotNull(), F.struct("time", "r"))).alias("end"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "bucket", F.last("end", True).over(before)["r"].alias("carried"))
    joined = placed.join(carried, ["key", "bucket"]).select("l.*", F.coalesce("found", "carried").alias("r"))
    unknown = left.where(F.col(left_key).isNull() | F.col(left_time).isNull()).withColumn("r", taken)
    return joined.unionByName(unknown).select(*left.columns, *(F.col("r")[c].alias(c) for c in right.columns))
