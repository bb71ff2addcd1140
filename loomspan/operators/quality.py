"""Quality gates: rules as predicates, violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass; every rule has a row."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(code) for code, ok in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.col(c).alias("violations")) for c in rules))).alias("x")).select("x.*")


def chart_shape(shares: Column) -> Column:
    """The shape of a chart of shares (an array of numbers of 0 to 100)."""
    s = F.sort_array(shares, asc=False)
    n, first, second, last = F.size(s), F.get(s, F.lit(0)), F.coalesce(F.get(s, F.lit(1)), F.lit(0)), F.get(s, F.size(s) - 1)
    leads = (first >= second * 2) | ((first >= 80) & (second < 50))
    total = F.aggregate(s, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    overlap = F.when(n >= 5, "long_tail").when((n >= 3) & leads, "leader_field").otherwise("overlapping")
    return (
        F.when(n <= 1, "solo").when(total > 105, overlap).when(n >= 5, "long_tail").when(n == 2, "head_to_head")
        .when(first - last <= 15, "even_pack").when(leads, "leader_field").otherwise("even_pack")
    )
