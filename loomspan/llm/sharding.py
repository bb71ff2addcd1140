"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are shuffled by a seeded hash and ranked; a row's fractional rank is (rank - offset) / rows of its
source, the offset in (0, 1) drawn from the source's name, so that small sources don't all stand at the same place. Sorting
all rows by fractional rank spreads each source evenly over the whole order, and cutting that order into runs whose lengths
differ by one at most gives shards that each match the mixture.

Neither ranking gathers a source or the table in one task. Both count rows in buckets of the sort key first (hash bits, then
slices of the fractional rank), sum those counts, and number rows within buckets only; the buckets are even by construction.
Texts aren't moved unless asked for in carry.

Defined results: a null text has no bytes; null sources are one source; null doc_ids and repeated rows are ranked like any
other, ties falling to rows that are equal in all that is returned (rows of equal id and text share a bucket). Equal texts under
different ids aren't kept together: they are spread like any others. An empty table gives no rows. With fewer rows than
shards, some shards are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.sources.tables import table

#: Buckets that rows of one source, and slices that all rows, are numbered in. A constant number of counts, whatever the input.
BUCKET_BITS = 12


def source_key(source: Column) -> Column:
    """A key that is never null and tells a null source from any name."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def unit(text: Column) -> Column:
    """A number in (0, 1) from a text."""
    return (F.shiftrightunsigned(F.xxhash64(text), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def interleave(docs: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row; columns named in carry come along in a struct named row."""
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        source_key(F.col(source_col)).alias("s"), *([F.struct(*carry).alias("row")] if carry else []),
    )
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size")).withColumn("b", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("s", "b").agg(F.count("*").alias("n")).select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("s")).alias("n_s"))
    ranked = rows.join(counts, ["s", "b"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "doc_id", "text_crc32", "size")))
    slices = 1 << BUCKET_BITS
    ranked = ranked.withColumn("f", (F.col("rank") - unit(F.concat(F.lit(f"{seed}:"), "s"))) / F.col("n_s")).drop("b", "before", "n_s", "rank")
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("f") * slices), F.lit(slices - 1)))
    run = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 counts at most
    whole = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = ranked.groupBy("g").agg(F.count("*").alias("n")).select("g", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"))
    at = ranked.join(F.broadcast(cum), "g").withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("g").orderBy("f", "h", "s", "doc_id")) - 1)
    shard = F.expr(f"(pos * {shards}) div total")
    return at.withColumn("shard", shard.cast("int")).withColumn("slot", F.expr(f"pos - ((shard * total + {shards - 1}) div {shards})")).select("doc_id", "size", "text_crc32", "shard", "slot", *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 7, **names: str) -> None:
    """Write the rows of docs as Parquet, a folder for each shard, in the order of slots."""
    rows = interleave(docs, shards, seed, carry=docs.columns, **names).select("shard", "slot", "row.*") if not {"shard", "slot"} & set(docs.columns) else interleave(docs, shards, seed, carry=docs.columns, **names).select("shard", "slot", "row")
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_interleaved_shards(spark: SparkSession, root: str) -> DataFrame:
    """All documents in shards 0 to 39, by the law of even row counts; null texts have size 16."""
    out = interleave(table(spark, root, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
