"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a target number of words: its share, by weight, of a budget that is a multiple of all words; a target stops
at a multiple of its source's words and the excess is reshared by weight until none is above. That level is found in closed
form, from running sums over the sources sorted by the ratio of cap to weight.

Within a source each document expects target / words copies. Documents stand in order of size (so that the words taken follow
the copies taken), copies expected are summed along that order, one random offset is added for the source, and a document is
emitted once for each integer that the sum crosses. A source may hold most rows: its documents are numbered in buckets of
(size, hash bits) with the counts of the buckets before, never in one task.

Defined results: a null or empty text has size 0 and takes nothing; null sources are one source, the last; rows with a
null doc_id stand by their text; repeated rows count like any other. An empty table gives no rows; a source without words has target 0. The same seed and
rows give the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import WORD
from loomspan.llm.sharding import source_key
from loomspan.sources.tables import table

WEIGHTS, BUDGET, LIMIT, SEED = (3, 1, 2), 1.5, 2, 11


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, limit: int = LIMIT) -> DataFrame:
    """From a row for each source (s, source, source_size, n): the same with target. Some rows for each source: small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w.cast("double")).withColumn("cap", (F.col("source_size") * limit).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(whole)).withColumn("level", (F.col("total") * F.lit(float(budget)) - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(rest))
    # The first source, by ratio, that the level doesn't fill sets the level for all.
    rows = rows.withColumn("final", F.min_by(F.when(F.col("ratio") >= F.col("level"), F.col("level")), F.when(F.col("ratio") >= F.col("level"), F.col("ratio"))).over(whole))
    return rows.withColumn("target", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))).drop("weight", "cap", "ratio", "total", "level", "final")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, limit: int = LIMIT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row; columns named in carry come along in a struct named row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.col(source_col).cast("string").alias("source"), F.md5(text.cast("binary")).alias("t"),
        *([F.struct(*carry).alias("row")] if carry else []),
    ).withColumn("s", source_key(F.col("source")))
    rows = rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("t"), F.lit(""))).cast("binary"))).withColumn("b", F.substring("h", 1, 2))
    counts = rows.groupBy("s", "source", "size", "b").agg(F.count("*").alias("n"))
    level = targets(counts.groupBy("s", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, budget, limit)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "s").cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    level = level.withColumn("u", offset).withColumn("e", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).drop("source")
    # Rows before a bucket: those of smaller sizes (a row for each size of a source), and those of its size in buckets before.
    run = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    smaller = counts.groupBy("s", "size").agg(F.sum("n").alias("n")).select("s", "size", F.coalesce(F.sum("n").over(run("s").orderBy("size")), F.lit(0)).alias("smaller"))
    beside = counts.select("s", "size", "b", F.coalesce(F.sum("n").over(run("s", "size").orderBy("b")), F.lit(0)).alias("beside"))
    before = beside.join(smaller, ["s", "size"]).select("s", "size", "b", (F.col("smaller") + F.col("beside")).alias("before"))
    placed = rows.drop("source").join(before, ["s", "size", "b"]).withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("s", "size", "b").orderBy("h", "doc_id", "t")))
    crossed = F.floor(F.col("i") * F.col("e") + F.col("u")) - F.floor((F.col("i") - 1) * F.col("e") + F.col("u"))
    out = placed.join(level, "s").withColumn("copies", crossed).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "copies", "taken", *(["row"] if carry else []))


def op8_systematic_mix(spark: SparkSession, root: str) -> DataFrame:
    """All documents with their sources' targets and the words the mix takes of each."""
    return mix(table(spark, root, "documents")).drop("copies")


OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS s, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
             md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS h FROM documents),
z AS (SELECT s, source, sum(size) AS source_size FROM d GROUP BY ALL),
w AS (SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS cap FROM z),
r AS (SELECT *, cap / weight AS ratio, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM w),
f AS (SELECT min_by(lev, ratio) AS lev FROM r WHERE ratio >= lev),
t AS (SELECT s, CAST(source_size AS BIGINT) AS source_size, least(cap, coalesce((SELECT lev FROM f) * weight, cap)) AS target,
             CAST(CAST('0x' || substr(md5('{SEED}:' || s), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM r),
i AS (SELECT d.*, row_number() OVER (PARTITION BY s ORDER BY size, h, doc_id) AS i FROM d),
e AS (SELECT i.doc_id, i.size, i.i, t.*, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e FROM i JOIN t USING (s))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (floor(i * e + u) - floor((i - 1) * e + u)) AS BIGINT) AS taken FROM e
"""
