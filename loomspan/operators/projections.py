"""Several views of the same rows in one pass over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def projections(rows: DataFrame, views: dict[str, tuple[list[str], str | None]], aggregates: list[Column]) -> DataFrame:
    """view, the keys of all views and the aggregates, for each group of each view: (its keys, a condition on keys or None). The
    rows are read once and each is counted in each set of keys, partly before the shuffle; views of the same keys share a set.
    Null keys are groups like others."""
    keys = list(dict.fromkeys(k for own, _ in views.values() for k in own))
    sets = list(dict.fromkeys(tuple(k for k in keys if k in own) for own, _ in views.values()))
    number = {s: sum(1 << len(keys) - 1 - i for i, k in enumerate(keys) if k not in s) for s in sets}
    grouped = rows.groupingSets([[F.col(k) for k in s] for s in sets], *(F.col(k) for k in keys)).agg(*aggregates, F.grouping_id().cast("long").alias("_set"))
    names = [F.when((F.col("_set") == number[tuple(k for k in keys if k in own)]) & (F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))), F.lit(v)) for v, (own, where) in views.items()]
    return grouped.select(F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())).alias("view"), *(c for c in grouped.columns if c != "_set"))
