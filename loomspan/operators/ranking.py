"""Winners, caps and interleaving by window functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return _ranked(df, by, order, "_n").where("_n = 1").drop("_n")


def capped(df: DataFrame, by: Sequence[str], order: Sequence[Column], most: int, unless: Column | None = None) -> DataFrame:
    """The first `most` rows of each key; rows for which `unless` holds all stay."""
    keep = F.col("_n") <= most
    return _ranked(df, by, order, "_n").where(keep if unless is None else keep | unless).drop("_n")


def round_robin(df: DataFrame, by: str, order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows, taking one of each key in turn; turn says in which."""
    return _ranked(df, [by], order, "turn").where(F.col("turn") <= most).orderBy("turn", by).limit(most)


def winners(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows that come first for every key they have; a null key excludes nothing, and rows without a key aren't gathered."""
    wins = F.lit(True)
    for k in keys:
        salt = F.when(F.col(k).isNull(), F.xxhash64(*df.columns))
        n = F.row_number().over(Window.partitionBy(F.col(k), salt).orderBy(*order))
        df = df.withColumn(f"_{k}", n)
        wins = wins & (F.col(k).isNull() | (F.col(f"_{k}") == 1))
    return df.where(wins).drop(*(f"_{k}" for k in keys))


def quota_then_refill(df: DataFrame, kind: str, origin: str, order: Sequence[Column], per_origin: int, per_kind: int, most: int) -> DataFrame:
    """per_origin rows of each (kind, origin), then per_kind of each kind first, then the others in order, `most` in all."""
    fair = capped(df, [kind, origin], order, per_origin)
    ranked = _ranked(fair, [kind], order, "_k").withColumn("refill", F.when(F.col("_k") <= per_kind, 0).otherwise(1))
    return ranked.orderBy("refill", kind, "_k").limit(most).drop("_k")
