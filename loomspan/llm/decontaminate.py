"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

Texts are lower-cased and cut into tokens, runs of letters and digits. A leak is a stretch of WINDOW tokens of a benchmark item
(the whole item, if that is shorter) that a document holds, token by token along one offset, with at least 0.8 of them the same.

A mask is a fixed set of offsets; the hash of the tokens at those offsets ignores the tokens between, so a passage still shares
hashes with its source after tokens were substituted. MASKS are chosen so that any stretch of 7 tokens or more with 0.8 the
same, wherever the others differ, holds one of them in whole; SHORT has the masks of items of 1 to 6 tokens, used where the
benchmark has such items. So no leak is missed (a test enumerates all patterns of every length).

Hashes of the masks at all places of the documents are joined with those of the benchmark. Before that, places whose first
tokens or whose hash no seed of the benchmark has are left out, by two bit tables of fixed size. Each place hit names a
document, a block of an item and the offset between them; along it the document is held against the block and what lies within
a window of it. The benchmark's hashes, blocks and the keys of documents hit are broadcast while their counted bytes are within
a bound; past it the joins shuffle. Only documents that were hit are read again.

Defined results: null or empty texts and items have no tokens and match nothing. Tokens of a window that lie outside the document
differ. Items of equal tokens are one, named by the smallest item_id; so are rows of equal doc_id and text. Null doc_ids are kept.
Of offsets that match alike the least is reported. Empty tables give no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import stored, work_folder
from loomspan.sources.tables import table

#: Masks as (tokens that count, tokens ignored, tokens that count).
MASKS = ((2, 1, 3), (3, 3, 2), (2, 0, 3), (3, 1, 2))
#: Of items of up to 6 tokens, by their number; those of 6 have MASKS besides.
SHORT = {1: ((1, 0, 0),), 2: ((2, 0, 0),), 3: ((3, 0, 0),), 4: ((4, 0, 0),), 5: ((1, 1, 3), (2, 1, 2), (3, 1, 1), (4, 0, 0)), 6: ((1, 1, 4), (4, 1, 1))}
WINDOW = 20
#: Least share of equal tokens, as a fraction of whole numbers.
P, Q = 4, 5
#: Tokens of an item that are verified together.
BLOCK = 64
#: Most bytes of one side that is broadcast.
BROADCAST_BYTES = 48 << 20


def masks_of(n: int) -> tuple:
    """The masks that items of n tokens are sown with."""
    return (MASKS if n > 5 else ()) + SHORT.get(n, ())


def tokens(text: Column) -> Column:
    """Hashes of a text's tokens."""
    words = F.filter(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.coalesce(F.transform(words, lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _seed(w: Column, i: Column, mask: tuple[int, int, int]) -> Column:
    a, gap, b = mask
    return F.xxhash64(F.lit(f"{a} {gap} {b}"), *(F.get(w, i + o) for o in (*range(a), *range(a + gap, a + gap + b))))


def _leads(w: Column, lead: int) -> Column:
    """For each place, what its first token, or its first two, come to; null where there is no second."""
    return w if lead == 1 else F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda x, y: x.bitwiseXOR(F.shiftleft(y, 1)))


def _places(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sown(m: Column, mask: tuple[int, int, int], lengths: list[int]) -> Column:
    """q, h, lead, first for each place of a mask in items m of these lengths (7: or more); first is what their first `lead` tokens come to."""
    lead = min(mask[0], 2)
    places = F.when(F.least(F.size(m), F.lit(7)).isin(lengths), F.size(m) - (sum(mask) - 1)).otherwise(0)
    return F.transform(_places(places), lambda q: F.struct(q.alias("q"), _seed(m, q, mask).alias("h"), F.lit(lead).alias("lead"), (F.get(m, q) if lead == 1 else F.get(m, q).bitwiseXOR(F.shiftleft(F.get(m, q + 1), 1))).alias("first")))


def _filter_of(hashes: DataFrame) -> Callable[[Column], Column]:
    """From hashes (h): whether a hash may be one of them. A table of 2**20 bits, whatever their number."""
    h = F.col("h")
    words = hashes.select(F.shiftrightunsigned(h, 50).cast("int").alias("k"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 44) & 63 as int))").alias("bit")).groupBy("k").agg(F.bit_or("bit").alias("bits"))
    bits = [0] * (1 << 14)
    for r in words.collect():  # 16,384 rows at most
        bits[r["k"]] = r["bits"]
    known = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")  # folded to one constant
    return lambda x: F.getbit(F.get(known, F.shiftrightunsigned(x, 50).cast("int")), F.shiftrightunsigned(x, 44).bitwiseAND(F.lit(63)).cast("int")) == 1


def _bounded(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """df (stored), to be broadcast if the sum of its rows' bytes is small enough."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _candidates(rows: DataFrame, known: DataFrame, masks: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, text_hash, p, h: places of rows (doc_id, text_hash, w) where a seed of known may stand."""
    seen, w = _filter_of(known), F.col("w")

    def found(own: list[tuple[int, int, int]], lead: int) -> Column:
        may = _filter_of(known.where(F.col("lead") == lead).select(F.col("first").alias("h")))
        at = F.array_compact(F.transform(_leads(w, lead), lambda x, i: F.when(may(x), i)))
        every = F.flatten(F.transform(at, lambda i: F.array(*(F.struct(i.alias("p"), _seed(w, i, m).alias("h")) for m in own))))
        return F.filter(every, lambda x: seen(x["h"]))

    groups = [(own, lead) for own, lead in (([m for m in masks if m[0] > 1], 2), ([m for m in masks if m[0] == 1], 1)) if own]
    out = F.concat(*(found(own, lead) for own, lead in groups))
    return rows.select("doc_id", "text_hash", F.explode(out).alias("x")).select("doc_id", "text_hash", "x.p", "x.h")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, item_id, place (the token of the document where the item would start), matched, compared, overlap of each leak; the best offset of each document and item."""
    spark = docs.sparkSession
    folder = work_folder(spark, "leaks")
    items = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(item_text)).alias("m")).where(F.size("m") > 0)
    items = stored(items.groupBy("m").agg(F.min("item_id").alias("item_id")), f"{folder}/items")
    m, n = F.col("m"), F.size("m")
    lengths = [r["n"] for r in items.select(F.least(n, F.lit(7)).alias("n")).distinct().orderBy("n").collect()]  # 7 at most
    masks = list(dict.fromkeys(x for k in lengths for x in masks_of(k)))
    sown = [_sown(m, x, [k for k in lengths if x in masks_of(k)]) for x in masks]
    known = stored(items.select("item_id", F.explode(F.concat(*sown) if sown else F.array().cast("array<struct<q:int,h:bigint,lead:int,first:bigint>>")).alias("x")).select("item_id", "x.*"), f"{folder}/seeds")
    # Blocks of items, each with what windows that reach into it hold besides.
    low = F.greatest(F.lit(0), F.col("b") * BLOCK - (WINDOW - 1))
    blocks = items.select("item_id", "m", F.explode(_places(F.ceil(n / BLOCK).cast("int"))).alias("b"))
    blocks = stored(blocks.select("item_id", "b", low.alias("low"), F.least(n, F.lit(WINDOW)).alias("n"), F.slice(m, low + 1, (F.col("b") + 1) * BLOCK + WINDOW - low).alias("m")), f"{folder}/blocks")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).alias("text"))
    places = _candidates(rows.select("doc_id", "text_hash", tokens(F.col("text")).alias("w")), known, masks) if masks else rows.where("false").select("doc_id", "text_hash", F.lit(0).alias("p"), F.lit(0).cast("long").alias("h"))
    # An offset is hit once for each block, whatever the masks and the places along it.
    hits = places.join(_bounded(known.select("item_id", "q", "h"), 64), "h").select("doc_id", "text_hash", "item_id", (F.col("p") - F.col("q")).alias("place"), F.expr(f"cast(q div {BLOCK} as int)").alias("b")).distinct()
    hits = stored(hits, f"{folder}/hits")
    docs_hit = stored(hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct(), f"{folder}/docs")
    keys = _bounded(docs_hit, 64)
    # Tokens of documents that were hit; the copies of one row are one.
    again = rows.join(keys, rows["doc_id"].eqNullSafe(F.col("d")) & (rows["text_hash"] == F.col("t")), "left_semi")
    again = again.select("doc_id", "text_hash", tokens(F.col("text")).alias("w")).groupBy("doc_id", "text_hash").agg(F.first("w").alias("w"))
    both = hits.withColumnsRenamed({"doc_id": "d", "text_hash": "t"}).join(_bounded(blocks, F.size("m") * 8 + 64), ["item_id", "b"])
    both = again.join(both, again["doc_id"].eqNullSafe(F.col("d")) & (again["text_hash"] == F.col("t"))).drop("d", "t")
    at = F.col("place") + F.col("low")
    same = F.transform("m", lambda x, j: F.when((at + j >= 0) & (F.get("w", at + j) == x), 1).otherwise(0))
    # Equal tokens before each place; a window's are the difference of two.
    held = both.select("doc_id", "text_hash", "item_id", "place", "n", F.aggregate(same, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)).alias("sums"))
    held = stored(held, f"{folder}/held")
    best = held.withColumn("matched", F.array_max(F.transform(F.sequence(F.lit(0), F.size("sums") - 1 - F.col("n")), lambda k: F.get("sums", k + F.col("n")) - F.get("sums", k))))
    found = best.where(F.col("matched") * Q >= F.col("n") * P).select("doc_id", "text_hash", "item_id", "place", "matched", F.col("n").alias("compared"), (F.col("matched") / F.col("n")).alias("overlap"))
    return found.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by(F.struct("place", "matched", "compared", "overlap"), F.struct("overlap", -F.col("place"))).alias("x")).select("doc_id", "text_hash", "item_id", "x.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """docs without those that leak; all their columns stay."""
    folder = work_folder(docs.sparkSession, "clean")
    bad = stored(leaks(docs, benchmark, id_col, text_col, **names).select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_t")).distinct(), f"{folder}/bad")
    return docs.join(_bounded(bad, 64), docs[id_col].eqNullSafe(F.col("_d")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("_t")), "left_anti")


def op3_spaced_seed_leaks(spark: SparkSession, root: str) -> DataFrame:
    """Passages of benchmark in documents: one row for each document and item."""
    return leaks(table(spark, root, "documents"), table(spark, root, "benchmark")).drop("text_hash")


#: No masks here: a window with 0.8 of its tokens the same holds a run of equal tokens, of 3 from 10 tokens on, of 2 from 2 on;
#: all offsets with such a run are compared.
OP3_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT min(item_id) AS item_id, m, CASE WHEN len(m) >= 10 THEN 3 ELSE least(len(m), 2) END AS g
      FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS m FROM benchmark) WHERE len(m) > 0 GROUP BY m),
gs AS (SELECT DISTINCT g FROM b),
dk AS (SELECT doc_id, text, g, p, w[p + 1:p + g] AS k FROM (SELECT doc_id, text, w, g, unnest(range(0, len(w) - g + 1)) AS p FROM d, gs)),
bk AS (SELECT item_id, g, q, m[q + 1:q + g] AS k FROM (SELECT *, unnest(range(0, len(m) - g + 1)) AS q FROM b)),
h AS (SELECT DISTINCT doc_id, text, item_id, p - q AS place FROM dk JOIN bk ON dk.g = bk.g AND dk.k = bk.k),
s AS (SELECT h.*, least(len(m), 20) AS n, len(m) AS lm, list_transform(range(0, len(m)), lambda j: CASE WHEN place + j >= 0 AND place + j < len(w) AND w[place + j + 1] = m[j + 1] THEN 1 ELSE 0 END) AS same
      FROM h JOIN b USING (item_id) JOIN d ON h.doc_id IS NOT DISTINCT FROM d.doc_id AND h.text = d.text),
t AS (SELECT *, list_max(list_transform(range(1, lm - n + 2), lambda x: list_sum(same[x:x + n - 1]))) AS matched FROM s)
SELECT doc_id, item_id, CAST(place AS INTEGER) AS place, CAST(matched AS INTEGER) AS matched, CAST(n AS INTEGER) AS compared, matched / n AS overlap
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, item_id ORDER BY matched / n DESC, place) AS r FROM t WHERE 5 * matched >= 4 * n) WHERE r = 1
"""
