"""Substring dedup over a log-structured fingerprint index.

A window is `words` consecutive words of one document. Its fingerprint is the hash of its least gram (of the window's grams of
`gram` words, the one with the least hash, the leftmost of equals): equal windows have it at the same offset, and neighbouring
windows mostly share it, so an index of fingerprints has one entry for some twelve windows and misses none. Windows that
follow each other and share their gram make one entry: (fp, span), span the hash of the text that they cover and of their layout.

The index is a list of immutable runs, tables of (fp, span, n) bucketed and sorted by fp. A new batch becomes a run of its own
and is merge-joined with the runs of the past, without moving them; fingerprints met before, or twice in the batch, are
recorded as shared. When runs are many they are merged into one, counts summed, and the old ones are deleted.

Shared fingerprints are candidates. To verify: an entry whose whole span occurs twice is repeated as a whole. Where spans
differ (at the edges of a copied passage), the windows of one occurrence of each span are compared by the hash of their own
words. Both comparisons are of 128 bits in all (fp and span, or fp and the window's own hash), so at 10**12 entries two different
ones meet with a chance of some 10**-15. Groups of copies only ever meet as counts; no pairs of documents are made.

Defined results: a null or empty text has no words. Repeated rows (doc_id and text equal) get equal results. Null doc_ids
are kept. Documents shorter than a window stay whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import drop_folder, small_batches, stored, tasks, work_folder
from loomspan.sources.tables import table

WORDS, GRAM, BATCHES, RUNS = 35, 12, 3, 4
#: Words hashed at a time, however long a text is.
BLOCK = 1 << 19
#: Most bytes of one side that is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 48 << 20
#: A name is hot if it has this part of a task's share of all occurrences, or more.
SHARE = 4
_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2**64."""
    if n not in _POWERS:
        _POWERS.clear()
        base, inverse = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))
        _POWERS[n] = tuple(np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x)))) for x in (base, inverse))
    return _POWERS[n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def least_grams(h: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, where its least gram starts; and the grams' hashes. h: the words' hashes."""
    n = len(h)
    power, inverse = _powers(1 << max(10, int(n).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[:n])))
    grams = _mixed((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    at, reach, need = np.arange(len(grams), dtype=np.int32), 1, words - gram + 1
    while reach < need:
        step = min(reach, need - reach)
        a, b = at[:-step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        reach += step
    return at, grams


def entries(texts: pa.Array, words: int = WORDS, gram: int = GRAM):
    """doc, first window, number of windows, fp, span for each entry of each text, in blocks. Arrow cuts texts into words and
    numbers the distinct ones, so that each is hashed once a batch."""
    from xxhash import xxh3_64_intdigest, xxh64_intdigest

    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null("")))
    first = lists.offsets.to_numpy().astype(np.int64)
    first -= first[0]
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    hashes = np.array([xxh64_intdigest(w, 5) for w in coded.dictionary.to_pylist()], np.uint64)
    codes = coded.indices.to_numpy()
    # Lines of words joined by one space, and where each word starts in them.
    lines = pc.binary_join(lists, " ")
    data = memoryview(lines.buffers()[2] or b"")
    line = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset:lines.offset + len(lines)].astype(np.int64)
    size = pc.binary_length(flat).to_numpy().astype(np.int64)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    start = np.cumsum(size) - size + np.arange(len(size))
    place = start - np.repeat(start[np.minimum(first[:-1], max(0, len(start) - 1))] if len(start) else first[:-1], count) + line[owner]
    place = np.append(place, 0)
    share = words - gram + 1  # the most windows that can have one gram in common
    for block in range(0, len(codes), BLOCK):
        # One window before the block and as many after it as an entry may have: an entry is that of the block it starts in, whole.
        low = max(0, block - 1)
        h = hashes[codes[low:block + BLOCK + share + words - 1]]
        if len(h) < words:
            break
        at, grams = least_grams(h, words, gram)
        begin = np.arange(low, low + len(at))
        good = np.flatnonzero(begin + words <= first[owner[begin] + 1])
        if not len(good):
            continue
        own = owner[begin[good]]
        change = np.ones(len(good), bool)
        change[1:] = (at[good[1:]] != at[good[:-1]]) | (own[1:] != own[:-1])
        head = np.flatnonzero(change)
        s, n, d = good[head], np.diff(np.append(head, len(good))), own[head]
        here = (begin[s] >= block) & (begin[s] < block + BLOCK)
        s, n, d = s[here], n[here], d[here]
        p, a = at[s], begin[s]
        last = a + n - 1 + words - 1
        span = [xxh3_64_intdigest(data[x:y], k) for x, y, k in zip(place[a].tolist(), (place[last] + size[last]).tolist(), ((p - s) * 64 + n).tolist())]
        yield d, a - first[d], n, grams[p].view(np.int64), np.array(span, np.uint64).view(np.int64)


def counted(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """fp, span, n of docs (doc_id, text), counted within each batch of a task; a name can come several times."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, _, fp, span in entries(b.column(0), words, gram):
                both, n = np.unique(np.stack((fp, span), 1), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n.astype(np.int64))], names=["fp", "span", "n"])

    return docs.select("text").mapInArrow(run, "fp long, span long, n long")


def located(docs: DataFrame, words: int = WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, k, s, c, fp, span: each entry with its document (k: hash of the text), its first window and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, s, n, fp, span in entries(b.column(2), words, gram):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), b.column(1).take(pa.array(d)), pa.array(s.astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(fp), pa.array(span)], names=["doc_id", "k", "s", "c", "fp", "span"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "k", "text").mapInArrow(run, f"doc_id {kind}, k long, s long, c int, fp long, span long")


class FingerprintIndex:
    """Sorted immutable runs of (fp, span, n) under a folder, and the fingerprints found to be shared."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, most: int = RUNS):
        self.spark, self.folder, self.buckets, self.most = spark, folder, buckets or tasks(spark), most
        self.runs: list[str] = []
        self.hits: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprint_run_{uuid.uuid4().hex[:12]}"
        rows.write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_folder(self.spark, f"{self.folder}/{name}")

    def _union(self) -> DataFrame:
        rows = self.spark.table(self.runs[0])
        for r in self.runs[1:]:
            rows = rows.union(self.spark.table(r))
        return rows

    def append(self, rows: DataFrame) -> None:
        """Add a batch of (fp, span, n): a new run; what it shares with itself or with the past is recorded."""
        rows = rows.repartition(self.buckets, "fp").groupBy("fp", "span").agg(F.sum("n").alias("n")).sortWithinPartitions("fp")
        name = self._write(rows)
        new = self.spark.table(name).groupBy("fp").agg(F.sum("n").alias("n"))
        found = new.where("n > 1").select("fp")
        for past in self.runs:
            found = found.union(new.join(self.spark.table(past).select("fp").distinct(), "fp").select("fp"))
        path = f"{self.folder}/shared_{len(self.hits)}"
        found.distinct().write.parquet(path)
        self.hits.append(path)
        self.runs.append(name)
        if len(self.runs) > self.most:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one."""
        if len(self.runs) > 1:
            merged = self._union().repartition(self.buckets, "fp").groupBy("fp", "span").agg(F.sum("n").alias("n")).sortWithinPartitions("fp")
            name = self._write(merged)
            for old in self.runs:
                self._drop(old)
            self.runs = [name]

    def shared(self) -> DataFrame:
        """(fp, span, n, spans) of all fingerprints that occur more than once; spans: how many different spans theirs has."""
        fps = self.spark.read.parquet(*self.hits).distinct()
        rows = self._union().groupBy("fp", "span").agg(F.sum("n").alias("n")).join(fps, "fp")
        spans = rows.groupBy("fp").agg(F.count("*").alias("spans"))
        return rows.join(spans, "fp")

    def close(self) -> None:
        for r in self.runs:
            self._drop(r)
        drop_folder(self.spark, self.folder)


def _bounded(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """df (stored), to be broadcast if the sum of its rows' bytes is small enough."""
    size = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _found(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """rows (of located) joined with shared (stored) by name. A name that a large part of rows may have is dealt over as many
    salts as a stage has tasks; such names are SHARE times the tasks at most."""
    n = tasks(rows.sparkSession)
    total, name = shared.agg(F.sum("n")).first()[0] or 0, F.xxhash64("fp", "span")
    hot = [r["h"] for r in shared.where(F.col("n") * (n * SHARE) > total).select(name.alias("h")).collect()] if total > n * SHARE else []
    if not hot:
        return rows.join(shared, ["fp", "span"])
    dealt = rows.withColumn("salt", F.when(name.isin(hot), F.pmod(F.xxhash64("doc_id", "k", "s"), F.lit(n)).cast("int")).otherwise(0))
    every = shared.withColumn("salt", F.explode(F.when(name.isin(hot), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(every, ["fp", "span", "salt"]).drop("salt")


def _windows(docs: DataFrame, words: int) -> DataFrame:
    """docs (text, parts of s, c, fp, span): fp, span, o, w for each window of the parts, w the hash of its words."""

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for b in batches:
            out = [[], [], [], []]
            for text, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ws = (text or "").encode().split()
                line, at = b" ".join(ws), np.cumsum([0] + [len(w) + 1 for w in ws]).tolist()
                for p in parts:
                    for o in range(p["c"]):
                        a = p["s"] + o
                        for col, v in zip(out, (p["fp"], p["span"], o, xxh3_64_intdigest(line[at[a]:at[a + words] - 1]))):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(np.array(out[3], np.uint64).view(np.int64))], names=["fp", "span", "o", "w"])

    return docs.select("text", "parts").mapInArrow(run, "fp long, span long, o int, w long")


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def repeated(docs: DataFrame, words: int = WORDS, gram: int = GRAM, batches: int = BATCHES, folder: str | None = None, name: str | None = None) -> DataFrame:
    """docs (doc_id, text) joined with parts: array of (s, m), m the bits of the windows from s on that occur elsewhere too (null: none).

    Texts are dealt once, into a table of buckets by r, 128 bits that name a row by its doc_id and text; whatever is found of them
    later comes to them there, so that they don't move again. The table is called name and lies in folder: both are there
    until `release`, as what is returned reads them."""
    spark = docs.sparkSession
    folder, buckets = folder or work_folder(spark, "substrings"), tasks(spark)
    name = name or f"texts_{uuid.uuid4().hex[:12]}"
    row = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("k").cast("string")).cast("binary"))
    placed = docs.withColumn("k", _key(F.col("text"))).withColumn("r", row)
    placed.repartition(buckets, "r").write.format("parquet").bucketBy(buckets, "r").option("path", f"{folder}/{name}").saveAsTable(name)
    docs = spark.table(name)
    index = FingerprintIndex(spark, f"{folder}/index")
    for b in range(batches):
        index.append(counted(docs.where(F.pmod(F.xxhash64("doc_id", F.lit(b"x")), F.lit(batches)) == b), words, gram))
    index.compact()
    shared = stored(index.shared(), f"{folder}/shared")
    index.close()
    found = stored(_found(located(docs, words, gram), shared), f"{folder}/found")

    # Where spans of a fingerprint differ, the windows of one occurrence of each.
    edge = found.where("spans > 1").groupBy("fp", "span").agg(F.min(F.struct("doc_id", "k", "s", "c")).alias("x"))
    edge = edge.select("x.*", "fp", "span").groupBy(row.alias("r")).agg(F.collect_list(F.struct("s", "c", "fp", "span")).alias("parts"))
    edge = _bounded(stored(edge, f"{folder}/edge"), F.size("parts") * 64 + 96)
    w = _windows(docs.join(edge, "r"), words).distinct()
    twice = w.groupBy("fp", "w").agg(F.count("*").alias("n")).where("n > 1").select("fp", "w")
    bits = w.join(twice, ["fp", "w"]).groupBy("fp", "span").agg(F.bit_or(F.expr("shiftleft(1L, o)")).alias("bits"))
    whole = F.expr("shiftleft(1L, c) - 1")
    marks = found.join(stored(bits, f"{folder}/bits"), ["fp", "span"], "left").withColumn("m", F.when(F.col("n") > 1, whole).otherwise(F.coalesce("bits", F.lit(0))))
    parts = marks.where("m <> 0").groupBy("doc_id", "k", "s").agg(F.bit_or("m").alias("m")).groupBy(row.alias("r")).agg(F.collect_list(F.struct("s", "m")).alias("parts"))
    parts = _bounded(stored(parts, f"{folder}/parts"), F.size("parts") * 40 + 96)
    return docs.join(parts, "r", "left").select("doc_id", "text", "parts")


def release(spark: SparkSession, folder: str, name: str) -> None:
    """Remove the table and the folder of `repeated`."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    drop_folder(spark, folder)


def kept_words(text: str | None, parts: list[dict] | None, words: int = WORDS) -> tuple[int, list[bytes]]:
    """The number of words, and those that no repeated window covers."""
    ws = (text or "").encode().split()
    if not parts:
        return len(ws), ws
    s = np.array([p["s"] for p in parts])
    m = np.array([p["m"] for p in parts], np.uint64)
    starts = np.concatenate([s[(m >> np.uint64(o)) & np.uint64(1) == 1] + o for o in range(int(m.max()).bit_length())])
    cover = np.zeros(len(ws) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + words, -1)
    keep = np.cumsum(cover[:-1]) == 0
    return len(ws), [w for w, k in zip(ws, keep.tolist()) if k]


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, gram: int = GRAM, batches: int = BATCHES, kept: Column | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words left joined by one space, or what `kept` makes of them. The result is written to
    the shared folder and read from there; nothing else of this call remains."""
    spark = docs.sparkSession
    small_batches(spark)
    folder, name = work_folder(spark, "substrings"), f"texts_{uuid.uuid4().hex[:12]}"
    marked = repeated(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), words, gram, batches, folder, name)

    def run(batches):
        for b in batches:
            n, left, own_words = [], [], []
            for text, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                all_words, own = kept_words(text, parts, words)
                n.append(all_words)
                left.append(all_words - len(own))
                own_words.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(left, pa.int64()), pa.array(own_words, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    rows = marked.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_removed long, kept string")
    out = stored(rows if kept is None else rows.withColumn("kept", kept), work_folder(spark, "kept"))
    release(spark, folder, name)
    return out


def op5_log_structured_substrings(spark: SparkSession, root: str) -> DataFrame:
    """documents without words of 35-word windows that occur elsewhere too."""
    return dedupe(table(spark, root, "documents"), kept=F.sha2("kept", 256)).withColumnRenamed("kept", "kept_sha256")


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS s, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, s, md5(array_to_string(w[s:s + 34], ' ')) AS h FROM s),
t AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT r, unnest(range(s, s + 35)) AS i FROM h JOIN t USING (h)),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r),
k AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS keep FROM d LEFT JOIN g USING (r))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - len(keep) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(keep, lambda i: w[i]), ' '), '')) AS kept_sha256 FROM k
"""
