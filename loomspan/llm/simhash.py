"""SimHash near-duplicates, with pigeonring filtering of candidates.

A 64-bit fingerprint's m segments stand on a ring. If two fingerprints differ in t bits at most, then from some segment on,
every chain of l consecutive segments differs in l * t / m bits at most. With m = 16 and t = 2 the first seven segments of that
chain must be equal (a join key of 28 bits, for each of 16 starts), the first fifteen may differ in one bit, and only then is the
full distance looked at.

Only distinct fingerprints are compared, so exact copies cost nothing. A large group of near copies would still give links by
the square of its size, of which connectivity needs few: first, neighbours in the sorted order of each key's bucket are
linked; then, in each bucket, only fingerprints outside the bucket's largest component so far are held against the rest, and
only against other components. No link between components is lost, and no bucket is capped.

Defined results: a null or empty text has fingerprint zero, which links like any other; texts of fewer words than a shingle
are one shingle. Null doc_ids get fingerprints; a component's id is its smallest non-null doc_id. Repeated rows stay
repeated. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import release_memory, small_batches, stored, work_folder
from loomspan.llm.components import components
from loomspan.sources.tables import table

SHINGLE, SEED, SEGMENTS, DISTANCE = 3, 42, 16, 2
#: Shingles whose bits are counted at a time, however long a text is.
BLOCK = 1 << 17
#: Most bytes of ids that are broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprints of texts, as signed 64-bit numbers."""
    from xxhash import xxh64_intdigest

    counts, totals = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[int] = []
    owner: list[tuple[int, int]] = []  # document and the number of its hashes in held

    def count() -> None:
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0] + [n for _, n in owner[:-1]])
            np.add.at(counts, [d for d, _ in owner], np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            held.clear()
            owner.clear()

    for d, text in enumerate(texts):
        words = (text or "").encode().lower().split()  # bytes: lower() changes A-Z only, split() takes the six ASCII spaces only
        if not words:
            continue
        line = b" ".join(words)
        starts = np.cumsum([0] + [len(w) + 1 for w in words])
        k = min(shingle, len(words))
        a, z = starts[: len(words) - k + 1].tolist(), (starts[k:] - 1).tolist()
        totals[d] = len(a)
        for i in range(0, len(a), BLOCK):
            own = [xxh64_intdigest(line[x:y], seed) for x, y in zip(a[i:i + BLOCK], z[i:i + BLOCK])]
            held.extend(own)
            owner.append((d, len(own)))
            if len(held) >= BLOCK:
                count()
    count()
    return np.packbits(2 * counts > totals[:, None], axis=1, bitorder="little").view("<i8").reshape(-1) if len(texts) else np.zeros(0, "<i8")


def fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of one text by its shingles' hashes (uint64), as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[i:i + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints_of(b.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])
        release_memory()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _rotated(fp: Column, bits: int) -> Column:
    return F.shiftleft(fp, bits).bitwiseOR(F.shiftrightunsigned(fp, 64 - bits)) if bits else fp


def _chain(x: Column, segments: int, distance: int) -> Column:
    """Whether the differing bits x of two rotated fingerprints stay in budget for each chain from the first segment on."""
    width, ok = 64 // segments, F.lit(True)
    for n in range(1, segments + 1):
        budget = n * distance // segments
        if n == segments or (n + 1) * distance // segments > budget:  # sums only grow: the longest chain of a budget decides
            ok = ok & (F.bit_count(F.shiftrightunsigned(x, 64 - n * width) if n < segments else x) <= budget)
    return ok


def _ring(fps: DataFrame, distance: int, segments: int) -> DataFrame:
    """fp, i, r (fp rotated by i segments) and key (the segments of r that chains within distance leave equal) for each fp and i."""
    width = 64 // segments
    key_bits = width * next(n for n in range(segments, 0, -1) if n * distance // segments == 0)
    ring = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _rotated(F.col("fp"), i * width).alias("r")) for i in range(segments)))).alias("x"))
    return ring.select("fp", "x.i", "x.r", F.shiftrightunsigned("x.r", 64 - key_bits).alias("key"))


def _beside(ring: DataFrame, distance: int, segments: int) -> DataFrame:
    bucket = Window.partitionBy("i", "key").orderBy("r")
    both = ring.withColumn("was", F.lag("r").over(bucket)).withColumn("v", F.lag("fp").over(bucket))
    return both.where(F.col("was").isNotNull() & _chain(F.col("r").bitwiseXOR(F.col("was")), segments, distance)).select(F.col("fp").alias("u"), "v")


def beside(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """fps (fp, distinct): pairs (u, v) of at most distance bits that are neighbours in some bucket of the ring, sixteen for each fp at most."""
    return _beside(_ring(fps, distance, segments), distance, segments)


def classes(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """fps (fp, distinct): (fp, root) with root the least fingerprint reachable by links of at most distance bits."""
    folder = work_folder(fps.sparkSession, "simhash")
    ring = _ring(fps, distance, segments)
    near = components(_beside(ring, distance, segments))
    known = stored(fps.join(near.withColumnRenamed("u", "fp"), "fp", "left").select("fp", F.coalesce("v", "fp").alias("c")), f"{folder}/known")
    # Spark sizes the ring as its fingerprints, of which it is a multiple: a hint keeps it from being broadcast.
    rows = ring.hint("merge").join(known, "fp")
    per = rows.groupBy("i", "key", "c").agg(F.count("*").alias("n")).groupBy("i", "key").agg(F.max_by("c", F.struct("n", "c")).alias("most"), F.count("*").alias("several")).where("several > 1")
    # Buckets of one component have nothing left to find; in the others every pair of components has a side that isn't the largest.
    rest = rows.join(per.drop("several"), ["i", "key"])
    few = rest.where("c <> most").select("i", "key", F.col("r").alias("r2"), F.col("c").alias("c2"))
    x = F.col("r").bitwiseXOR(F.col("r2"))
    far = rest.join(few, (rest["i"] == few["i"]) & (rest["key"] == few["key"]) & (F.col("c") != F.col("c2")) & _chain(x, segments, distance)).select(F.col("c").alias("u"), F.col("c2").alias("v"))
    joined = components(far)
    return known.join(joined.withColumnRenamed("u", "c"), "c", "left").select("fp", F.coalesce("v", "c").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    spark = docs.sparkSession
    folder = work_folder(spark, "fingerprints")
    rows = stored(fingerprints(docs, id_col, text_col), f"{folder}/rows")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{folder}/distinct")
    root = stored(classes(fps.select("fp"), distance, segments), f"{folder}/root")
    whole = fps.join(root, "fp")
    ids = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = whole.join(ids, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes_of=near_duplicates) -> DataFrame:
    """docs with one document of each component, that of the smallest doc_id; all columns stay. Rows equal in all columns are
    one document. Rows without a doc_id stay: nothing names them. The ids that go are broadcast while their count is small."""
    spark = docs.sparkSession
    folder = work_folder(spark, "deduplicate")
    found = stored(classes_of(docs, id_col, text_col).select("doc_id", "component_id"), f"{folder}/classes")
    gone = stored(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), f"{folder}/gone")
    ids = F.broadcast(gone) if gone.count() * 24 <= BROADCAST_BYTES else gone
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return (docs.dropDuplicates() if repeated else docs).join(ids, docs[id_col] == F.col("_gone"), "left_anti")


def op9_simhash_pigeonring(spark: SparkSession, root: str) -> DataFrame:
    """documents with their fingerprints and near-duplicate components."""
    return near_duplicates(table(spark, root, "documents"))
