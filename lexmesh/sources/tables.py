"""Tables of a folder, by any of Spark's readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text")


def read_table(spark: SparkSession, folder: str, name: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """The table ``name`` of ``folder``; filters and columns reach the reader as far as its format allows."""
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    reader = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(f"{folder}/{name}.{kind}")


def write_table(df: DataFrame, folder: str, name: str, kind: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    if kind not in FORMATS:
        raise ValueError(f"kind must be one of {FORMATS}")
    df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}), **options).save(f"{folder}/{name}.{kind}")


def all_words(df: DataFrame, text: str) -> DataFrame:
    """Distinct lower-case words (column ``word``) of a text column: all runs of letters and digits."""
    return df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word")).distinct()
