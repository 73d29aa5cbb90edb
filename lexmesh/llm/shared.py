"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's own; a temporary one on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexmesh-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. ``options`` are the writer's.
    """
    return written(df, name, options)[0]


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/lexmesh/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Intermediate tables of one job, to be removed once what was made of them is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def clear(self) -> None:
        self.drop(*(table for table, _ in list(self.paths.values())))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in ``ids`` (doc_id, distinct, written); nulls stay.

    Up to ``most`` ids (16 bytes each) are counted and then broadcast, which spares the texts a shuffle;
    more are joined by a shuffle of both sides.
    """
    own = free_prefix(docs, "__gone_") + "id"
    gone = ids.select(F.col("doc_id").alias(own))
    return docs.join(F.broadcast(gone) if gone.count() <= most else gone, F.col("doc_id") == F.col(own), "left_anti")


def hash_sample(rows: DataFrame, most: int, seed: int, *ties: str) -> DataFrame:
    """At most ``most`` of ``rows``, the first by a hash of doc_id (then by it and ``ties``).

    The count of the rows gives a bound for the hash that about ``most`` of them pass; the tasks drop the
    others, so what they send to the driver does not grow with the table.
    """
    full = F.xxhash64(F.lit(seed), "doc_id")
    bucket = F.pmod(F.shiftright(full, 8), F.lit(1 << 24))
    total = rows.count()
    if total > most:
        near = rows.where(bucket < math.ceil((1.05 * most + 500) / total * (1 << 24)))
        # Ids that are often repeated may leave too few.
        if near.count() >= most:
            rows = near
    return rows.orderBy(bucket, full, "doc_id", *ties).limit(most)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix, lengthened until no column of ``df`` starts with it."""
    while any(c.startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus
