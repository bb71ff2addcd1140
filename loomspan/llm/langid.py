"""Language identification by mixture inference.

A model holds, for each language, smoothed probabilities of hashed byte trigrams of lower-cased letters. A document is taken
as a mixture: expectation-maximisation finds the proportions of languages that make its trigrams likeliest. The set of
languages is chosen by penalised likelihood: from the likeliest single language on, the next by proportion is added while it
raises the log-likelihood by more than its penalty, which grows with the logarithm of the document's trigrams. The predicted
language is the one of the largest proportion within that set, and the proportion is the score.

The classifier is fitted on a bounded sample: about `per_language` documents of each language, drawn by a hash of id and text
(a documented bound; with fewer, all). Its counts are summed by Spark; what the driver gets is one table of BUCKETS counts for
each language, which grows with the languages and not with the documents.

Defined results: `und` with score 0 for a null text, one without letters, or where nothing was learned. Null languages aren't
learned from. A null id counts as the empty text in the hash that holds documents out. Repeated rows get equal results; ties
between languages fall to the first by code point. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import release_memory, small_batches
from loomspan.sources.tables import table

BITS = 15
BUCKETS = 1 << BITS
PER_LANGUAGE, SMOOTH, PENALTY, ROUNDS = 3000, 0.5, 6.0, 12
#: Bytes hashed at a time, however long a text is.
BLOCK = 1 << 20
#: Bytes that aren't part of a letter become spaces: all of ASCII but a to z.
_LETTERS = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))
UND = "und"


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Whether the CRC-32 of an id as text leaves this remainder."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % parts == part


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's trigrams, and how often each occurs. Runs of spaces between letters are one place."""
    data = b" " + b" ".join(text.lower().encode().translate(_LETTERS).split()) + b" "
    total = None
    for a in range(0, max(1, len(data) - 2), BLOCK):
        x = np.frombuffer(data, np.uint8)[a:a + BLOCK + 2].astype(np.uint32)
        if len(x) < 3:
            break
        h = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
        h ^= h >> np.uint32(15)
        n = np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS), minlength=BUCKETS)
        total = n if total is None else total + n
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(total)
    return at, total[at]


class Model:
    """Languages and the probabilities of buckets in each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + SMOOTH
        self.p = (p / p.sum(axis=0)).astype(np.float64) if languages else counts

    @staticmethod
    def _em(p: np.ndarray, c: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions after ROUNDS, and their log-likelihood."""
        pi = start
        for _ in range(ROUNDS):
            pi = (c / (p @ pi)) @ p * pi
            pi = pi / pi.sum()
        return pi, float(c @ np.log(p @ pi))

    def proportions(self, text: str) -> dict[str, float]:
        """The chosen languages and their proportions."""
        at, c = trigrams(text)
        if not self.languages or not len(at):
            return {}
        p = self.p[at]
        single = c @ np.log(p)
        first = int(np.argmax(single))
        if len(self.languages) == 1:
            return {self.languages[0]: 1.0}
        whole, most = self._em(p, c, np.full(p.shape[1], 1 / p.shape[1]))
        penalty = PENALTY * np.log(1 + c.sum())
        chosen, best, pi = [first], float(single[first]), np.ones(1)
        for k in np.argsort(-whole, kind="stable").tolist():
            if k == first:
                continue
            if most - best <= penalty:  # no set gains more than the whole one does
                break
            more, ll = self._em(p[:, [*chosen, k]], c, np.append(pi * (1 - max(whole[k], 0.05)), max(whole[k], 0.05)))
            if ll - best <= penalty:
                break
            chosen, best, pi = [*chosen, k], ll, more
        return {self.languages[k]: float(x) for k, x in zip(chosen, pi)}

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letters(text) or not (mix := self.proportions(text)):
            return UND, 0.0
        language = max(sorted(mix), key=mix.__getitem__)
        return language, min(1.0, mix[language])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, id_col: str = "doc_id") -> Model:
    """Learn from the texts and non-null languages of docs. Where docs has no id_col, the text alone draws the sample."""
    small_batches(docs.sparkSession)
    name = [F.col(id_col).cast("string")] if id_col in docs.columns else []
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(3), F.col(text_col).cast("string"), *name).alias("h")).where("lang IS NOT NULL AND text IS NOT NULL")
    share = rows.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"))
    few = share.count() * 64 <= 48 << 20  # a row for each language
    drawn = rows.join(F.broadcast(share) if few else share, "lang").where((F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(1 << 53))) < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, n = trigrams(text)
                np.add.at(totals.setdefault(lang, np.zeros(BUCKETS, np.int64)), at, n)
        for lang, n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
        release_memory()

    summed = drawn.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(summed["lang"].unique().tolist())
    counts = np.zeros((BUCKETS, len(languages)))
    for k, lang in enumerate(languages):
        own = summed[summed["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] = (), pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """The columns in keep, the predicted language and its score for each row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kept = [F.col(c) for c in keep]
    inside = text_col in keep and docs.schema[text_col].dataType.simpleString() == "string"  # then the text isn't sent twice
    at = list(keep).index(text_col) if inside else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            got = [own.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[0 if inside else 1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*keep, pred_col, score_col])
        release_memory()

    rows = docs.select(*([] if inside else [F.col(text_col).cast("string").alias("_text")]), *kept)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{pred_col}` string", f"`{score_col}` double"]))


def op2_language_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The language of each document, learned from those whose id isn't held out."""
    docs = table(spark, root, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    return predict(rows, model, keep=["doc_id", "held_out"])
