"""Token counts through a cache of digests.

A text's normal form has its runs of ASCII white space made one space and, where that can't change its tokens, its letters in
lower case. The SHA-256 of the normal form, with a digest of the tokenizer's version (its file, the library's version, the
way it is called), is the key of a count in the cache, a Parquet table in a folder:

    tokenizer=V/    digest, n_tokens

A call joins the digests of its documents (32 bytes each, not the texts) to the cache; only distinct digests that miss are
encoded, each once, and their counts are appended. While the missing digests are few, they are broadcast behind their size
and texts that hit never move; beyond that bound, the same join shuffles. Texts that move are compressed, once for each task
that holds a copy, so a text that makes up a third of all rows is one small row of each task.

An append that is cut short leaves nothing (files appear when the job commits); two calls at once may both append a digest,
which counts once.

Defined results: a null or empty text has no tokens; rows with a null doc_id and repeated rows stay, each with its count. An
empty table gives no rows. Very long texts are encoded whole, in words. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import blocks, drop_folder, release_memory, small_batches, stored, tasks, work_folder
from loomspan.sources.tables import table

LIMIT = 2048
#: Most bytes of digests that are broadcast; beyond it the joins shuffle.
BROADCAST_BYTES = 48 << 20
#: Texts with a sign beyond Latin letters (combining marks are among them) or with a start of a special string keep their case.
_FAR = re.compile("[^\x00-ɏ]")
#: A letter or digit and marks at a word's end.
_MARKS, _TAIL = ".,;:!?", r"[\p{L}\p{N}][.,;:!?]{1,4}$"
#: Words whose counts a worker remembers: half of them are the latest, half are from the generation before; bytes of text encoded at a time; digests a task remembers to have sent.
MEMORY, BLOCK_BYTES, SENT = 400_000, 4 << 20, 500_000


def normal(text: str | None) -> str:
    """The normal form of a text: equal forms have equal counts."""
    plain = b" ".join((text or "").encode().split()).decode()  # bytes: split() takes the six ASCII spaces only
    return plain if not plain.isascii() and _FAR.search(plain) or "<|" in plain else plain.lower()


def digest(form: str) -> bytes:
    return hashlib.sha256(form.encode()).digest()


class Counter:
    """Counts of a tokenizer that drops white space: words between spaces are counted on their own, and remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def words(self, words: list[str]) -> np.ndarray:
        young, old, encode = self.young, self.old, self.tokenizer.encode_batch_fast
        new = [w for w in words if w not in young and w not in old]
        own: dict[str, int] = {}
        for i in range(0, len(new), 1 << 14):
            part = new[i:i + (1 << 14)]
            own.update(zip(part, (len(e.ids) for e in encode(part, add_special_tokens=False)), strict=True))
        got = [own[w] if w in own else young[w] if w in young else old[w] for w in words]
        young.update(zip(words, got))
        if len(young) > MEMORY // 2:
            self.young, self.old = {}, young
        return np.array(got, np.int64)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens of each text in normal form. Marks after a letter or digit at a word's end are always tokens of their
        own, so they are counted apart."""
        if not len(texts):
            return np.zeros(0, np.int64)
        lists = pc.split_pattern(texts.cast(pa.large_string()), " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        pieces = coded.dictionary
        heads = pc.if_else(pc.match_substring_regex(pieces, _TAIL), pc.utf8_rtrim(pieces, characters=_MARKS), pieces)
        cut = pc.binary_length(heads).to_numpy() < pc.binary_length(pieces).to_numpy()
        n = self.coded(heads)
        if cut.any():
            own = pc.binary_length(heads.filter(pa.array(cut))).to_numpy()
            n[cut] += self.coded(pa.array([p[k:] for p, k in zip(pieces.filter(pa.array(cut)).cast(pa.large_binary()).to_pylist(), own.tolist())], pa.large_binary()).cast(pa.large_string()))
        return np.add.reduceat(n[coded.indices.to_numpy()], offsets[:-1] - offsets[0])

    def coded(self, words: pa.Array) -> np.ndarray:
        x = words.dictionary_encode()
        return self.words(x.dictionary.to_pylist())[x.indices.to_numpy()]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def version(path: str) -> str:
    """A digest of all that a count depends on besides the text."""
    import tokenizers

    h = hashlib.sha256(f"tokenizers {tokenizers.__version__}, no added tokens\n".encode())
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def cached(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """digest, n_tokens of a tokenizer's version, each digest once."""
    at = f"{cache}/tokenizer={of}"
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema("digest binary, n_tokens long").parquet(at).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(1)
        n = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), n, pa.array([digest(normal(t)) for t in texts.to_pylist()], pa.binary())], names=["doc_id", "n_bytes", "digest"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each digest's text once a task, compressed."""
    import zstandard

    press, sent = zstandard.ZstdCompressor(3), set()
    for b in blocks(batches, 0, BLOCK_BYTES):
        out = {}
        for t in b.column(0).to_pylist():
            form = normal(t)
            if (d := digest(form)) not in sent:
                sent.add(d)
                out[d] = press.compress(form.encode())
        if len(sent) > SENT:
            sent.clear()
        yield pa.RecordBatch.from_arrays([pa.array(out.keys(), pa.binary()), pa.array(out.values(), pa.binary())], names=["digest", "packed"])


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_press, count, last = zstandard.ZstdDecompressor(), counter(path), None
        for b in blocks(batches, 1, BLOCK_BYTES // 4):
            digests, texts = [], []
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):  # sorted: copies of other tasks stand together
                if d != last:
                    digests.append(d)
                    texts.append(open_press.decompress(x))
                    last = d
            n = count.counts(pa.array(texts, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(n, pa.int64())], names=["digest", "n_tokens"])
        release_memory()

    return run


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; counts that the cache lacks are appended to it."""
    spark, of = docs.sparkSession, version(tokenizer)
    small_batches(spark)
    folder = work_folder(spark, "token-counts")
    text = F.col(text_col).cast("string").alias("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(_digests, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, digest binary")
    rows = stored(rows, f"{folder}/rows")
    asked = stored(rows.select("digest").distinct(), f"{folder}/asked")
    misses = stored(asked.join(cached(spark, cache, of), "digest", "left_anti"), f"{folder}/misses")
    small = asked.count() * 64 <= BROADCAST_BYTES
    if missing := misses.count():
        few = F.broadcast(misses) if missing * 64 <= BROADCAST_BYTES else misses.hint("merge")
        packed = docs.select(text).mapInArrow(_packed, "digest binary, packed binary").join(few, "digest", "left_semi")
        new = packed.repartition(tasks(spark), "digest").sortWithinPartitions("digest").mapInArrow(_encoder(tokenizer), "digest binary, n_tokens long")
        new.write.mode("append").parquet(f"{cache}/tokenizer={of}")
    counts = cached(spark, cache, of).join(asked, "digest", "left_semi")
    if small:
        counts = F.broadcast(stored(counts, f"{folder}/counts"))
    drop_folder(spark, f"{folder}/misses")
    n = F.col("n_tokens")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", n, (n > limit).alias("over_limit"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op12_digest_cache(spark: SparkSession, root: str) -> DataFrame:
    """documents with their token counts, through a cache of this call's own, so that no call's work depends on another's."""
    return count_tokens(table(spark, root, "documents"), work_folder(spark, "token-cache"), default_tokenizer())
