"""Shared handling of column arguments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(n: Column | int | None) -> Column:
    return n.cast("bigint") if isinstance(n, Column) else F.lit(n).cast("bigint")
