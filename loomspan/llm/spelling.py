"""Groups of spelling variants, by anagram hashing.

A word's key is the sum of its letters' fifth powers (modulo a prime), whatever their order. Taking a letter away subtracts
its value. So words one insertion or deletion apart have keys that differ by one letter's value, and words one replacement
apart have the same key once each has lost the letter replaced. Each word therefore offers, for each of its letters, the key
without it; these offers are joined to keys of words (additions, removals) and to each other (exchanges).

Words of one key are anagrams, which may be many. So the letters' order is verified within the join: an offer also
carries a hash of the sequence that is left (of 61 bits, by prefixes, so that a run of a million letters costs a million steps),
and only equal sequences meet: no pair of mere anagrams is made. Words that leave the same sequence when they lose a letter at the
same place differ in that letter only, so there are at most as many as letters (90); each needs of the others only their
number and the best of them, which is one of the first two by count. A key, a sequence and a place take 20 bytes however long
the word is.

Counting comes first, in the scan's tasks: they count into tables of bounded size and only (word, count) rows are shuffled.

Defined results: null texts have no runs; a null doc_id is written as nothing before the colon; repeated rows count as
often as they occur. Empty tables give no rows. Runs that lose a letter may fall below the least length and go. Runs of any
length are words like others. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import LOWER, UPPER, drop_folder, release_memory, small_batches, stored, tasks, work_folder
from loomspan.sources.tables import table

LEAST_LENGTH, LEAST_COUNT, FACTOR, EVERY, POWER = 5, 3, 2, 97, 5
PRIME, BASE = (1 << 61) - 1, 1_000_003
#: Words that a task counts before it hands them on; characters of a text that are cut into runs at a time.
HELD, STRETCH = 400_000, 1 << 20
#: Rows of forms in a file.
ROWS = 500_000
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_LOW = str.maketrans(UPPER, LOWER)


def _stretches(text: str) -> Iterator[str]:
    a = 0
    while a < len(text):
        stop = _BREAK.search(text, a + STRETCH) if a + STRETCH < len(text) else None
        z = stop.start() if stop else len(text)
        yield text[a:z]
        a = z


def _counted(every: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                for part in _stretches(text or ""):
                    for raw, n in Counter(_RUN.findall(part)).items():
                        w = raw if raw.islower() else raw.translate(_LOW)
                        h = zlib.crc32(w.encode(), start)
                        if h % every == 0:
                            i = h % len(w)
                            w = w[:i] + w[i + 1:]
                        if len(w) >= least:
                            counts[w] += n
                    if len(counts) >= HELD:
                        yield flush()
        if counts:
            yield flush()
        release_memory()

    return run


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words of texts."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_counted(every, least_length), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# Of words


def _value(c: str) -> int:
    return pow(ord(c), POWER, PRIME)


def key_of(word: str) -> tuple[int, int]:
    """A word's anagram key, and the hash of its letters in order."""
    k = s = 0
    for c in word:
        k, s = (k + _value(c)) % PRIME, (s * BASE + ord(c)) % PRIME
    return k, s


def offers_of(word: str) -> Iterator[tuple[int, int, int, bool]]:
    """For each letter: its place, the key without it, the hash of the letters left in order, and whether its left neighbour
    is another letter (letters of a run leave the same sequence)."""
    key, _ = key_of(word)
    after, scale = [0] * (len(word) + 1), [1] * (len(word) + 1)
    for i in range(len(word) - 1, -1, -1):
        after[i] = (after[i + 1] + ord(word[i]) * scale[i + 1]) % PRIME
        scale[i] = scale[i + 1] * BASE % PRIME
    before, last = 0, ""
    for i, c in enumerate(word):
        yield i, (key - _value(c)) % PRIME, (before * scale[i + 1] + after[i + 1]) % PRIME, c != last
        before, last = (before * BASE + ord(c)) % PRIME, c


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [key_of(w) for w in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([x[j] for x in own], pa.int64()) for j in (0, 1))], names=["word", "n", "key", "seq"])


_OFFER = "id binary, n long, place int, letter int, opens boolean, key long, seq long"


def _offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word itself, at place -1, and what it offers."""
    types = pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64()
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["id", "n", "place", "letter", "opens", "key", "seq"])
    out: list[tuple] = []
    for b in batches:
        for w, n, d, key, seq in zip(*(c.to_pylist() for c in b.columns)):
            out.append((d, n, -1, 0, False, key, seq))
            for i, k, s, opens in offers_of(w):
                out.append((d, n, i, ord(w[i]), opens, k, s))
                if len(out) >= 1 << 15:
                    yield pack(out)
                    out = []
    if out:
        yield pack(out)


def near(known: DataFrame) -> DataFrame:
    """known (id, word, n, key, seq): for each word, rows (id, n, other, other_n, near): near words and, of those that differ
    by a replacement at one place, the best with their number."""
    rows = known.select("word", "n", "id", "key", "seq").mapInArrow(_offers, _OFFER)
    same = Window.partitionBy("key", "seq")
    place = Window.partitionBy("key", "seq", "place").orderBy(F.col("n").desc(), "letter")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct("id", "n")
    rows = rows.withColumn("short", F.max(F.when(F.col("place") < 0, me)).over(same))
    rows = rows.withColumn("k", F.count("*").over(whole)).withColumn("one", F.first(me).over(whole)).withColumn("two", F.nth_value(me, 2).over(whole)).where("place >= 0")
    pair = lambda a, b, k: F.struct(a["id"].alias("id"), a["n"].alias("n"), b["id"].alias("other"), b["n"].alias("other_n"), F.lit(k).alias("near") if isinstance(k, int) else k.alias("near"))
    added = F.when(F.col("opens") & F.col("short").isNotNull(), F.array(pair(me, F.col("short"), 1), pair(F.col("short"), me, 1)))
    other = F.when(F.col("one")["id"] == F.col("id"), F.col("two")).otherwise(F.col("one"))
    changed = F.when(F.col("k") > 1, F.array(pair(me, other, (F.col("k") - 1).cast("int"))))
    none = F.array().cast("array<struct<id:binary,n:bigint,other:binary,other_n:bigint,near:int>>")
    return rows.select(F.explode(F.concat(F.coalesce(added, none), F.coalesce(changed, none))).alias("x")).select("x.*")


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """forms (id, form): id and the last of the forms that follow it. Each round doubles the steps that are known; counts at
    least double along forms, so there are at most some six rounds. Few rows are written as few files."""
    spark, k = forms.sparkSession, 0
    files = min(tasks(spark), 1 + forms.count() // ROWS)
    now = stored(forms.select("id", F.col("form").alias("root")).coalesce(files), f"{folder}/root0")
    while True:
        step = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        k += 1
        new = stored(now.join(step, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).coalesce(files), f"{folder}/root{k}")
        if not new.where("moved").limit(1).count():
            return new.select("id", "root")
        now = new.select("id", "root")
        if k > 1:
            drop_folder(spark, f"{folder}/root{k - 2}")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY, factor: int = FACTOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, form, root, n, n_near, form_n for each word."""
    spark = docs.sparkSession
    folder = work_folder(spark, "spelling")
    rows = words(docs, least_length, least_count, every, id_col, text_col).mapInArrow(_keys, "word string, n long, key long, seq long")
    known = stored(rows.withColumn("id", F.unhex(F.md5(F.col("word").cast("binary")))), f"{folder}/words")
    links = stored(near(known), f"{folder}/links")
    count = links.groupBy("id").agg(F.sum("near").alias("n_near"))
    name = known.select(F.col("id").alias("other"), F.col("word").alias("form"))
    # Only neighbours that may be a form need their names, which decide ties.
    best = links.where(F.col("other_n") >= F.col("n") * factor).join(name, "other").groupBy("id").agg(F.min(F.struct((-F.col("other_n")).alias("m"), "form", "other")).alias("x"))
    forms = stored(best.select("id", "x.form", F.col("x.other").alias("next"), (-F.col("x.m")).alias("form_n")), f"{folder}/forms")
    last = roots(forms.select("id", F.col("next").alias("form")), folder)
    named = last.join(name.withColumnRenamed("form", "root_word"), F.col("root") == F.col("other")).select("id", "root_word")
    out = known.select("id", "word", "n").join(count, "id", "left").join(forms.drop("next"), "id", "left").join(named, "id", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_anagram_variants(spark: SparkSession, root: str) -> DataFrame:
    """The words of all documents, with their forms and roots."""
    return variants(table(spark, root, "documents"))


#: crc32 by its bits, as DuckDB has none; near words by the sequences that are left when a letter goes, without keys.
OP11_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS raw FROM documents),
r AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT w, n, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen(s), 1), lambda i: CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS BIGINT))) AS bytes
      FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s FROM r)),
h AS (SELECT w, n, xor(4294967295, list_reduce(bytes, lambda c, x: list_reduce(list_prepend(xor(c, x), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) AS h FROM b),
d AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM h),
k AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM d WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
o AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM k)),
shorter AS (SELECT DISTINCT o.word, o.n, k.word AS other, k.n AS other_n FROM o JOIN k ON k.word = o.rest),
p AS (SELECT * FROM shorter UNION ALL SELECT other, other_n, word, n FROM shorter
      UNION ALL SELECT a.word, a.n, z.word, z.n FROM o a JOIN o z ON a.rest = z.rest AND a.i = z.i AND a.word <> z.word),
f AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) FILTER (WHERE other_n >= 2 * n) AS form, max(other_n) FILTER (WHERE other_n >= 2 * n) AS form_n FROM p GROUP BY word),
up AS (SELECT word, word AS root FROM k UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL),
last AS (SELECT up.word, up.root FROM up LEFT JOIN f ON f.word = up.root WHERE f.form IS NULL)
SELECT k.word, f.form, last.root, k.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM k JOIN last USING (word) LEFT JOIN f USING (word)
"""
