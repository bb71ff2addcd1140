"""Proposals from vectors: a label's prototype is the mean of its vectors; a row is given the label of the prototype it is most like,
if it is like it enough and clearly more than the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most bytes of prototypes.
BROADCAST_BYTES = 48 << 20


def fitted(rows: DataFrame, vector: str, label: str) -> DataFrame:
    """label, prototype: the mean of each dimension over a label's vectors. Dimensions are summed where they are read; rows without a
    label or vector don't count."""
    parts = rows.where(F.col(label).isNotNull()).select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda p: p["m"]).alias("prototype"))  # as long as a vector


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the vectors is zero or their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def proposed(rows: DataFrame, key: str, vector: str, prototypes: DataFrame, label: str, threshold: float, margin: float) -> DataFrame:
    """key, slot (the accepted label or null). All prototypes go to each row as one broadcast row, whose size is checked; rows don't
    move. Ties go to the smaller label."""
    size = prototypes.agg(F.coalesce(F.sum(F.size("prototype") * 8 + 32), F.lit(0))).first()[0]
    if size > BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of prototypes; {BROADCAST_BYTES} at most")
    every = prototypes.agg(F.collect_list(F.struct(F.col(label).alias("label"), "prototype")).alias("_every"))
    score = lambda p: F.struct((-F.round(cosine(F.col(vector), p["prototype"]), 9)).alias("s"), p["label"].alias("label"))
    scored = rows.select(key, vector).crossJoin(F.broadcast(every)).select(key, F.array_sort(F.filter(F.transform("_every", score), lambda x: x["s"].isNotNull())).alias("_s"))
    best, second = F.get("_s", F.lit(0)), F.get("_s", F.lit(1))
    ok = (-best["s"] >= threshold) & (second.isNull() | (second["s"] - best["s"] >= margin))
    return scored.select(key, F.when(ok, best["label"]).alias("slot"))
