"""Sites that have topics in common: a join of sets by similarity, for each site its nearest ones.

Topics of a site are ranked, rare ones first, over all sites alike. Two sets that are similar enough share one of the first few topics of
each (the prefix), so only prefixes meet, in an inverted index; common topics stand at the ends of large sets and hardly ever do.
A pair must also pass the bound by sizes and the bound by places (what is left of both sets after the topic they meet at). What
passes is counted exactly, topic by topic, in joins: no set is gathered. Sites without topics have no pairs; null topics are none.
The nearest sites are looked for among distinct sets only: sites with the same topics stand behind the least of them, and copies never
meet as pairs.
Where few topics are shared by nearly all sites, prefixes rule out hardly any pair, and to write pairs down takes disk by the square of the
sites. There the nearest are found block by block: each task holds two blocks of sets, counts what they share as a product of matrices,
and sends on only the nearest of each set. Its work is still that of all pairs, its memory that of two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.streaming.ledger import new_folder

#: Most sets and most topics of sets in a block, on average; sets of one block that are held against another at a time; topics of one product.
SETS, TOPICS, ROWS, COLUMNS = 1 << 14, 1 << 21, 1 << 10, 1 << 9
#: Pairs whose similarities are worked out at a time.
CELLS = 1 << 19
#: Prefixes may meet that often before blocks are asked for; so many cells of a product cost as much as one such meeting.
MEETINGS, WORTH = 1 << 20, 10_000


def prefixes(sets: DataFrame, site: str, topic: str, least: float) -> DataFrame:
    """site, topic, size, place of the topics of each site that a similar one must share one of."""
    own = sets.select(site, topic).dropna().distinct()
    df = own.groupBy(topic).agg(F.count("*").alias("df"))
    by_rarity = Window.partitionBy(site).orderBy("df", topic)
    whole = Window.partitionBy(site)
    rows = own.join(df, topic).withColumn("place", F.row_number().over(by_rarity)).withColumn("size", F.count("*").over(whole)).drop("df")
    return rows.where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * least) + 1)


def pairs(sets: DataFrame, site: str, topic: str, least: float) -> DataFrame:
    """left, right (left < right), shared, similarity (Jaccard) of all pairs with similarity `least` or more."""
    p = prefixes(sets, site, topic, least)
    a = p.select(topic, F.col(site).alias("left"), F.col("size").alias("n"), F.col("place").alias("i"))
    b = p.select(topic, F.col(site).alias("right"), F.col("size").alias("m"), F.col("place").alias("j"))
    n, m = F.col("n"), F.col("m")
    sizes = (n >= m * least) & (m >= n * least)
    places = 1 + F.least(n - F.col("i"), m - F.col("j")) >= F.ceil((n + m) * (least / (1 + least)) - 1e-9)
    met = a.join(b, topic).where((F.col("left") < F.col("right")) & sizes & places).select("left", "right", "n", "m").distinct()
    own = sets.select(site, topic).dropna().distinct()
    sides = met.join(own.select(F.col(site).alias("left"), topic), "left").join(own.select(F.col(site).alias("right"), topic), ["right", topic])
    shared = sides.groupBy("left", "right", "n", "m").agg(F.count("*").alias("shared"))
    return shared.withColumn("similarity", F.col("shared") / (n + m - F.col("shared"))).where(F.col("similarity") >= least).select("left", "right", "shared", "similarity")


def classes(own: DataFrame, site: str, topic: str) -> DataFrame:
    """site, of: the least site with just the same topics. Sets are compared by their size and two sums of 64-bit hashes."""
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), topic).cast("decimal(38,0)"))
    sums = own.groupBy(site).agg(F.count("*").alias("_n"), h(1).alias("_a"), h(2).alias("_b"))
    least = sums.groupBy("_n", "_a", "_b").agg(F.min(site).alias("of"))
    return sums.join(least, ["_n", "_a", "_b"]).select(site, "of")


def _dense(at: np.ndarray, topic: np.ndarray, sets: slice, columns: slice) -> np.ndarray:
    """1 where a set of `sets` has a topic of `columns`; sets at[k] have topics topic[k], in order of sets."""
    a, z = np.searchsorted(at, (sets.start, sets.stop))
    at, topic = at[a:z] - sets.start, topic[a:z] - columns.start
    own = (topic >= 0) & (topic < columns.stop - columns.start)
    out = np.zeros((sets.stop - sets.start, columns.stop - columns.start), np.float32)
    out[at[own], topic[own]] = 1
    return out


def _first_of(asked: pa.Table, other: pa.Table, least: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For sets of asked: places of sets, of the nearest in other (the `most` first by similarity and place, itself apart), and what they share."""
    size = [pc.list_value_length(t["topics"]).to_numpy().astype(np.int64) for t in (asked, other)]
    flat = [pc.list_flatten(t["topics"]).to_numpy() for t in (asked, other)]
    both = np.intersect1d(*map(np.unique, flat), assume_unique=True)  # other topics are shared by none
    at = []
    for n, t in zip(size, flat):
        k = np.searchsorted(both, t)
        known = k < len(both)
        known[known] = both[k[known]] == t[known]
        at.append((np.repeat(np.arange(len(n)), n)[known], k[known]))
    columns = [slice(c, min(c + COLUMNS, len(both))) for c in range(0, len(both), COLUMNS)]
    every = slice(0, len(size[1]))
    only = _dense(*at[1], every, columns[0]) if len(columns) == 1 else None
    same = pc.index_in(asked["site"], value_set=other["site"].combine_chunks()).combine_chunks()
    same = same.fill_null(-1).to_numpy()
    for a in range(0, len(size[0]), ROWS):
        rows = slice(a, min(a + ROWS, len(size[0])))
        shared = np.zeros((rows.stop - a, len(size[1])), np.float32)
        for c in columns:
            shared += _dense(*at[0], rows, c) @ (_dense(*at[1], every, c) if only is None else only).T
        step = max(1, CELLS // len(size[1]))
        for b in range(0, len(shared), step):
            s = shared[b:b + step]
            n = np.arange(len(s))
            near = s / (size[0][a + b:a + b + len(s), None] + size[1] - s.astype(np.float64))
            near[(near < least) | (s == 0)] = -1
            own = same[a + b:a + b + len(s)]
            near[n[own >= 0], own[own >= 0]] = -1
            for _ in range(min(most, near.shape[1])):
                k = near.argmax(axis=1)  # the first of equals
                good = near[n, k] >= 0
                if not good.any():
                    break
                yield a + b + n[good], k[good], s[n[good], k[good]].astype(np.int64)
                near[n, k] = -1


def _by_blocks(sets: DataFrame, site: str, topic: str, least: float, most: int, blocks: int) -> DataFrame:
    """_of, of, shared, similarity: for each set its `most` nearest other ones, the least sites of equals. Topics are numbered, in parts
    that don't share a number."""
    kind, parts = sets.schema[site].dataType.simpleString(), 64
    at = ((F.row_number().over(Window.partitionBy("_p").orderBy(topic)) - 1) * parts + F.col("_p")).cast("int")
    number = sets.select(topic).distinct().withColumn("_p", F.pmod(F.xxhash64(topic), F.lit(parts))).withColumn("_t", at).drop("_p")
    rows = sets.join(number, topic).groupBy(F.col(site).alias("site")).agg(F.array_sort(F.collect_list("_t")).alias("topics")).withColumn("_b", F.pmod(F.xxhash64("site"), F.lit(blocks)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    a = rows.select(F.col("_b").alias("_i"), F.explode(every).alias("_j"), F.lit(True).alias("_asked"), "site", "topics")
    b = rows.select(F.explode(every).alias("_i"), F.col("_b").alias("_j"), F.lit(False).alias("_asked"), "site", "topics")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("site")
        asked, other = (group.filter(pc.equal(group["_asked"], x)).combine_chunks() for x in (True, False))
        found = list(_first_of(asked, other, least, most)) if len(asked) and len(other) else []
        x, y, shared = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        n, m = (pc.list_value_length(t["topics"]).cast(pa.int64()).take(pa.array(k)) for t, k in ((asked, x), (other, y)))
        return pa.table([asked["site"].take(pa.array(x)), other["site"].take(pa.array(y)), pa.array(shared, pa.int64()), n, m], names=["_of", "of", "shared", "n", "m"])

    found = a.union(b).groupBy("_i", "_j").applyInArrow(run, f"_of {kind}, of {kind}, shared long, n long, m long")
    found = found.select("_of", "of", "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("similarity"))
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("_of").orderBy(F.desc("similarity"), "of"))).where(F.col("_k") <= most).drop("_k")


def _blocks(sets: DataFrame, site: str, topic: str, least: float) -> int:
    """How many blocks sets are dealt to; none where their prefixes hardly meet, so that a join of prefixes costs less."""
    x = sets.agg(F.count("*").alias("topics"), F.countDistinct(site).alias("sets"), F.countDistinct(topic).alias("kinds")).first()
    n = prefixes(sets, site, topic, least).groupBy(topic).agg(F.count("*").cast("double").alias("n"))
    met = n.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    if met <= MEETINGS or met * WORTH <= float(x["sets"]) ** 2 * x["kinds"]:
        return 0
    return max(-(-x["sets"] // SETS), -(-x["topics"] // TOPICS))


def _kept(rows: DataFrame, what: str) -> DataFrame:
    """rows, written once: several steps read them."""
    at = new_folder(rows.sparkSession, what)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def nearest(sets: DataFrame, site: str, topic: str, least: float, most: int) -> DataFrame:
    """site, other, shared, similarity, rank: the `most` nearest sites of each. Distinct sets are held against each other; of each near set
    its first `most` sites may be among the nearest, of a site's own set the first `most` and one, as the site itself is none. Only the first
    rows of a site are sent on by each task."""
    own = _kept(sets.select(site, topic).dropna().distinct(), "topics")
    c = _kept(classes(own, site, topic), "classes")
    one = own.join(c.where(F.col(site) == F.col("of")).select(site), site, "left_semi")
    sizes = one.groupBy(site).agg(F.count("*").alias("shared"))
    # Sets behind `most` others that are nearer, or as near and of a lesser site, hold none of the nearest sites.
    if blocks := _blocks(one, site, topic, least):
        near = _by_blocks(one, site, topic, least, most, blocks)
    else:
        found = pairs(one, site, topic, least)
        both = found.select(F.col("left").alias("_of"), F.col("right").alias("of"), "shared", "similarity").union(found.select("right", "left", "shared", "similarity"))
        near = both.withColumn("_k", F.row_number().over(Window.partitionBy("_of").orderBy(F.desc("similarity"), "of"))).where(F.col("_k") <= most).drop("_k")
    near = near.union(sizes.select(F.col(site).alias("_of"), F.col(site).alias("of"), "shared", F.lit(1.0).alias("similarity")))
    first = c.withColumn("_k", F.row_number().over(Window.partitionBy("of").orderBy(site))).where(F.col("_k") <= most + 1).select("of", F.col(site).alias("other"))
    order = (F.desc("similarity"), "other")
    by_set = near.join(first, "of").withColumn("_k", F.row_number().over(Window.partitionBy("_of").orderBy(*order))).where(F.col("_k") <= most + 1).drop("_k", "of")
    rows = c.withColumnRenamed("of", "_of").join(by_set, "_of").where(F.col(site) != F.col("other")).select(site, "other", "shared", "similarity")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(site).orderBy(*order))).where(F.col("rank") <= most)
