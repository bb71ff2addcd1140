"""Language-model scoring with a trigram trie in Elias-Fano levels.

Training counts the pairs and triples of neighbouring tokens (a text's start, its words, its end). Tasks count within an Arrow
batch and send each shard one block of sorted contexts, successors and theirs, so that a token costs some twelve bytes in the
shuffle. A shard becomes one file of the trie, in levels:

    contexts     the words' hashes, a sorted sequence
    counts       running sums of the contexts' counts: a word's count is the difference of two neighbours
    pointers     where each context's successors begin in the next level
    pairs        context's place * 2**LABEL_BITS + label of the next word: sorted, relative to its context
    pointers3    where each pair's successors begin in the last level
    triples      pair's place * 2**LABEL_BITS + label of the next word: sorted, relative to its pair
    codes        for each pair and triple a byte: its discounted count, quantised by 256 levels of the shard's own

All sequences are Elias-Fano coded and memory-mapped from the shared folder. A pair is looked up by the context's place, a triple
by the pair's, each by a successor search in the range of what it follows. Over the count of its context a discounted count is
the smoothed probability: with count c, context's count C, T different successors and the shard's discount D of the level,
P = (c - D) / C + (D T / C) P', P' being the same of the context without its first token, and at last p(word), the smoothed share
of the word in training; an unknown context gives P'.

A pair lies in the shard of its context's hash. Contexts that a large part of all tokens follow (found in a bounded sample; the
text's start always) lie in all shards, a pair by the hash of both words; their counts are summed up, some for each shard. A
shard takes about SHARD_BYTES of text, so shards grow in number with the corpus and not in size; each is made by one task, and a
task that scores maps each file once for GROUP_BYTES of text. Words are known by 56 bits of their hash.

Defined results: a null or empty text is its end alone; null doc_ids count as the empty text where the id's CRC holds documents
out, and are kept; repeated rows are counted and scored each. Without training rows every count is 0. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import LOWER, SPACES, UPPER, Store, blocks, release_memory, small_batches, stored, tasks, work_folder
from loomspan.llm.elias_fano import EliasFano
from loomspan.llm.langid import held_out
from loomspan.sources.tables import table

HASH_BITS, LABEL_BITS = 56, 40
#: Text of a shard; text of the sample in which hot contexts are looked for.
SHARD_BYTES, SAMPLE_BYTES = 24 << 20, 32 << 20
#: Bytes of texts that are counted at a time; bytes of texts that are looked up together, each file being mapped once for them.
BLOCK_BYTES, GROUP_BYTES = 3 << 20, 20 << 20
#: Stand for a text's start (a context only) and its end (a token): no word has a space.
START, END = b" start", b" end"
_SEQUENCES = ("contexts", "counts", "pointers", "pairs", "pointers3", "triples")
_LOW = np.uint64(HASH_BITS - LABEL_BITS)
_WIDE = LABEL_BITS // 8


def _hashes(words: Iterable[bytes], n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words, repeat(17)), np.uint64, n) >> np.uint64(64 - HASH_BITS)


def _hash(word: bytes) -> int:
    return int(_hashes([word], 1)[0])


def read_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the batch's distinct tokens (start and end among them); each text's tokens as places in it, an end
    after each; where each text's tokens end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    known, place = np.unique(np.concatenate((_hashes(words, len(words)), _hashes((START, END), 2))), return_inverse=True)
    index = coded.indices.to_numpy().astype(np.int64)
    full = (pc.binary_length(coded.dictionary).to_numpy() > 0)[index] if len(index) else np.zeros(0, bool)
    ends = np.concatenate(([0], np.cumsum(full)))[offsets - offsets[0]]
    tokens = np.insert(place[index[full]], ends[1:], place[-1])
    return known, tokens, ends[1:] + np.arange(1, len(texts) + 1)


def _contexts(known: np.ndarray, tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The token before each, the start before a text's first."""
    before = np.roll(tokens, 1)
    if len(ends):
        before[np.concatenate(([0], ends[:-1]))] = np.searchsorted(known, np.uint64(_hash(START)))
    return before


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _by_shard(shard: np.ndarray, shards: int) -> np.ndarray:
    """The order of rows by shard; few shards are sorted by their digits."""
    return np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")


class Counts:
    """A batch's distinct pairs (a, b: places in known; c: counts) and triples (pair: place in them, w: the next word, n: counts),
    and for each token its pair and, past a text's first, its triple. Pairs are sorted by a and b, triples by pair and w."""

    def __init__(self, texts: pa.Array):
        self.known, self.tokens, self.ends = read_tokens(texts)
        m = len(self.known)
        keys = _contexts(self.known, self.tokens, self.ends) * m + self.tokens
        pairs, self.of, self.c = np.unique(keys, return_inverse=True, return_counts=True)
        self.a, self.b = np.divmod(pairs, m)
        self.starts = np.concatenate(([0], self.ends[:-1])) if len(self.ends) else np.zeros(0, np.int64)
        follows = np.ones(len(self.tokens), bool)
        follows[self.starts] = False
        self.at = np.flatnonzero(follows)  # tokens with a triple
        triples, self.triple_of, self.n = np.unique(self.of[self.at - 1] * m + self.tokens[self.at], return_inverse=True, return_counts=True)
        self.pair, self.w = np.divmod(triples, m)


class Layout:
    """Which shard a pair lies in."""

    def __init__(self, shards: int, hot: np.ndarray):
        self.shards, self.hot = shards, np.sort(np.asarray(hot, np.uint64))
        self.bounds = np.array([(k << HASH_BITS) // shards for k in range(shards)], np.uint64)

    def is_hot(self, a: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hot, a), len(self.hot) - 1)
        return self.hot[at] == a if len(self.hot) else np.zeros(len(a), bool)

    def of_word(self, a: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, a, "right") - 1

    def of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        return np.where(self.is_hot(a), ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(self.shards)).astype(np.int64), self.of_word(a))


def _labels(x: np.ndarray) -> bytes:
    return (x >> _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_WIDE].tobytes()


def _unlabels(data: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :_WIDE] = np.frombuffer(data, np.uint8, n * _WIDE, at).reshape(n, _WIDE)
    return out.view("<u8").reshape(-1)


def _block(a: np.ndarray, b: np.ndarray, c: np.ndarray, per: np.ndarray, w: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs of hashes (a sorted, b) with counts and numbers of triples, and the triples' words and counts, as bytes."""
    import zstandard

    first = _runs(a)
    head = np.array([len(first), len(a), len(w)], "<i8").tobytes()
    packed = b"".join(x.astype("<u4").tobytes() for x in (np.diff(np.append(first, len(a))), c, per, n))
    return head + a[first].astype("<u8").tobytes() + _labels(b) + _labels(w) + zstandard.ZstdCompressor(level=1).compress(packed)


def _unblock(data: bytes) -> tuple[np.ndarray, ...]:
    """Context, label and count of each pair; pair, label and count of each triple."""
    import zstandard

    k, m, t = (int(x) for x in np.frombuffer(data, "<i8", 3))
    at = 24 + 8 * k
    contexts = np.frombuffer(data, "<u8", k, 24)
    rest = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + (m + t) * _WIDE:]), "<u4")
    count, per = rest[k:k + m], rest[k + m:k + 2 * m]
    return np.repeat(contexts, rest[:k]), _unlabels(data, m, at), count.astype(np.int64), np.repeat(np.arange(m), per), _unlabels(data, t, at + m * _WIDE), rest[k + 2 * m:].astype(np.int64)


def _counter(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 0, BLOCK_BYTES):
            x = Counts(batch.column(0))
            a, b = x.known[x.a], x.known[x.b]
            shard = layout.of_pair(a, b)
            order = _by_shard(shard, layout.shards)
            place = np.empty(len(a), np.int64)
            place[order] = np.arange(len(a))
            by_pair = np.argsort(place[x.pair], kind="stable")
            per = np.bincount(place[x.pair], minlength=len(a))
            done = np.concatenate(([0], np.cumsum(per)))
            a, b, c, shard, w, n = a[order], b[order], x.c[order], shard[order], x.known[x.w][by_pair], x.n[by_pair]
            first = _runs(shard)
            names, data = [], []
            for i, z in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
                names.append(int(shard[i]))
                data.append(_block(a[i:z], b[i:z], c[i:z], per[i:z], w[done[i]:done[z]], n[done[i]:done[z]]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["shard", "block"])
        release_memory()

    return run


def _summed(owner: np.ndarray, label: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys (owner * 2**LABEL_BITS + label), their counts, and where each row went."""
    keys = (owner.astype(np.uint64) << np.uint64(LABEL_BITS)) | label
    order = np.argsort(keys)
    keys = keys[order]
    first = _runs(keys)
    where = np.empty(len(order), np.int64)
    where[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    return keys[first], np.add.reduceat(count[order], first) if len(first) else count[:0], where


def _quantised(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Codes of discounted counts, the logarithms that they stand for, and the discount."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    discount = once / (once + 2 * twice) if once and twice else 0.5
    values, at = np.unique(counts, return_inverse=True)
    logs = np.log10(values - discount) if len(values) else np.zeros(1)
    book = logs[np.linspace(0, len(logs) - 1, 256).round().astype(np.int64)] if len(logs) > 256 else np.pad(logs, (0, 256 - len(logs)), mode="edge")
    right = np.clip(np.searchsorted(book, logs), 1, 255)
    code = np.where(logs - book[right - 1] <= book[right] - logs, right - 1, right).astype(np.uint8)
    return (code[at] if len(values) else np.zeros(0, np.uint8)), book, discount


def levels(contexts: np.ndarray, labels: np.ndarray, counts: np.ndarray, pair: np.ndarray, words: np.ndarray, times: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of one shard, from its pairs (context, label, count) and triples (place in the pairs, label, count) in any order."""
    known, place = np.unique(contexts, return_inverse=True)
    keys, counts, where = _summed(place, labels, counts)
    keys3, counts3, _ = _summed(where[pair], words, times)
    if max(len(known), len(keys)) >> (63 - LABEL_BITS) or len(keys3) >> 32:
        raise ValueError(f"a shard of {len(known)} contexts, {len(keys)} pairs and {len(keys3)} triples is too large: lower SHARD_BYTES")
    owner, owner3 = ((k >> np.uint64(LABEL_BITS)).astype(np.int64) for k in (keys, keys3))
    begin, begin3 = np.searchsorted(owner, np.arange(len(known) + 1)), np.searchsorted(owner3, np.arange(len(keys) + 1))
    total = np.add.reduceat(counts, begin[:-1])
    sums = np.concatenate(([0], np.cumsum(total))).astype(np.uint64)
    out = {"known": known, "total": total, "many": np.diff(begin)}  # for meta, not for the file
    for name, c in (("codes", counts), ("codes3", counts3)):
        code, book, discount = _quantised(c)
        out |= {name: code, f"{name}.book": book, f"{name}.discount": np.array([discount])}
    for name, v, u in (("contexts", known, 1 << HASH_BITS), ("counts", sums, int(sums[-1]) + 1), ("pointers", begin.astype(np.uint64), len(keys) + 1), ("pairs", keys, len(known) << LABEL_BITS), ("pointers3", begin3.astype(np.uint64), len(keys3) + 1), ("triples", keys3, max(1, len(keys)) << LABEL_BITS)):
        out |= {f"{name}.{k}": x for k, x in EliasFano.build(v, u).items()}
    return out


def _file(arrays: dict[str, np.ndarray]) -> list[bytes]:
    """A JSON head of names, types and places, then the arrays, each at a multiple of eight bytes."""
    at, head, parts = 0, {}, []
    for k, x in arrays.items():
        data = x.tobytes()
        head[k] = [x.dtype.str, at, len(x)]
        parts += [data, bytes(-len(data) % 8)]
        at += len(data) + -len(data) % 8
    top = json.dumps(head).encode()
    top += b" " * (-len(top) % 8)
    return [np.array([len(top)], "<i8").tobytes(), top, *parts]


class Shard:
    """One file of the trie, memory-mapped."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view("<i8")[0])
        base = 8 + n
        self.arrays = {k: np.ndarray((m,), t, data, base + at) for k, (t, at, m) in json.loads(data[8:8 + n].tobytes()).items()}
        self.contexts, self.counts, self.pointers, self.pairs, self.pointers3, self.triples = (EliasFano({k: self.arrays[f"{s}.{k}"] for k in ("shape", "low", "high", "rank")}) for s in _SEQUENCES)
        self.discount, self.discount3 = float(self.arrays["codes.discount"][0]), float(self.arrays["codes3.discount"][0])

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (or -1), count and number of successors of each word as a context."""
        at = self.contexts.find(hashes)
        ok, count, many = np.flatnonzero(at >= 0), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[ok], many[ok] = self.counts.step(at[ok]), self.pointers.step(at[ok])
        return at, count, many

    @staticmethod
    def _found(level: EliasFano, owner: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the successors of an owner (or of -1, which has none) are there, and their places."""
        i = np.flatnonzero(owner >= 0)
        at = level.find((owner[i].astype(np.uint64) << np.uint64(LABEL_BITS)) | labels[i])
        there = np.flatnonzero(at >= 0)
        return i[there], at[there]

    def successors(self, owner: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (or -1), code and number of successors (or -1) of each pair."""
        place, code, many = np.full(len(owner), -1, np.int64), np.zeros(len(owner), np.uint8), np.full(len(owner), -1, np.int32)
        i, at = self._found(self.pairs, owner, labels)
        if len(i):
            place[i], code[i], many[i] = at, self.arrays["codes"][at], self.pointers3.step(at)
        return place, code, many

    def last(self, owner: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The code of each triple, or -1."""
        code = np.full(len(owner), -1, np.int16)
        i, at = self._found(self.triples, owner, labels)
        if len(i):
            code[i] = self.arrays["codes3"][at]
        return code


class Asked:
    """What a block of texts asks of the trie, in the order of shards, and the answers: of words their count and mass, of pairs
    codes and numbers of successors, of triples codes."""

    def __init__(self, texts: pa.Array, layout: Layout):
        x = Counts(texts)
        self.known, self.ends, self.starts = x.known, x.ends, x.starts
        self.a, self.b, self.pair, self.w, self.of, self.triple_of = (v.astype(np.int32) for v in (x.a, x.b, x.pair, x.w, x.of, x.triple_of))
        del x
        shard = layout.of_pair(self.known[self.a], self.known[self.b])
        shard3 = shard[self.pair]
        self.order, self.order3 = _by_shard(shard, layout.shards).astype(np.int32), _by_shard(shard3, layout.shards).astype(np.int32)
        every = np.arange(layout.shards + 1)
        self.cut0, self.cut, self.cut3 = np.searchsorted(layout.of_word(self.known), every), np.searchsorted(shard[self.order], every), np.searchsorted(shard3[self.order3], every)
        self.count, self.mass = np.zeros(len(self.known), np.int64), np.zeros(len(self.known))
        self.code, self.many, self.code3 = np.zeros(len(self.a), np.uint8), np.full(len(self.a), -1, np.int32), np.full(len(self.pair), -1, np.int16)

    def shards(self) -> np.ndarray:
        """Which shards are asked."""
        return (np.diff(self.cut0) > 0) | (np.diff(self.cut) > 0)


def layout_of(docs: DataFrame) -> Layout:
    """Shards by the bytes of docs (text), and the contexts that more than a quarter of a shard's share of tokens follow in a
    sample by hash: fewer than four for each shard, whatever the corpus."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(tasks(spark), -(-size // SHARD_BYTES))
    part = max(1, size // SAMPLE_BYTES)
    low = F.translate("text", UPPER, LOWER)
    words = docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select(F.explode(F.split(low, SPACES)).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    hot = [r["w"] for r in words.where(F.col("n") * (4 * shards) > total).select("w").collect()]
    return Layout(shards, np.array([_hash(START), *(_hash(w.encode()) for w in hot)], np.uint64))


def fit(docs: DataFrame, root: str, text_col: str = "text") -> dict:
    """Count docs and write the trie under root; gives its totals."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(text_col).cast("string").alias("text"))
    layout = layout_of(docs)

    def build(key, g):
        import pandas as pd

        parts, base = [], 0
        for block in g["block"]:
            x = list(_unblock(block))
            x[3] = x[3] + base
            base += len(x[0])
            parts.append(x)
        arrays = levels(*(np.concatenate(x) for x in zip(*parts)))
        known, total, many = (arrays.pop(k) for k in ("known", "total", "many"))
        Store(root).write(f"trie/{key[0]:06d}.bin", _file(arrays))
        hot = layout.is_hot(known)
        rows = {"shard": [key[0]], "contexts": [int((~hot).sum())], "tokens": [int(total.sum())], "hot": [known[hot].view(np.int64).tolist()], "counts": [total[hot].tolist()], "mass": [(many[hot] * float(arrays["codes.discount"][0])).tolist()]}
        del arrays, parts
        release_memory()
        return pd.DataFrame(rows)

    blocks = docs.mapInArrow(_counter(layout), "shard int, block binary")
    made = stored(blocks.repartition(layout.shards, "shard").groupBy("shard").applyInPandas(build, "shard int, contexts long, tokens long, hot array<long>, counts array<long>, mass array<double>"), f"{root}/made")
    hot = made.select(F.explode(F.arrays_zip("hot", "counts", "mass")).alias("x")).groupBy("x.hot").agg(F.sum("x.counts").alias("n"), F.sum("x.mass").alias("mass")).collect()  # fewer than four for each shard
    rows = made.select("shard", "contexts", "tokens").collect()  # one for each shard
    meta = {
        "shards": layout.shards, "layout": [int(x) for x in layout.hot], "made": sorted(r["shard"] for r in rows), "tokens": sum(r["tokens"] for r in rows), "words": sum(r["contexts"] for r in rows) + len(hot),
        "hot": [[r["hot"], r["n"], r["mass"]] for r in hot],
    }
    Store(root).write("meta.json", [json.dumps(meta).encode()])
    return meta


class Trie:
    """All files of a trie; each is mapped while it answers a group of blocks, since pages that a task touched count as its memory."""

    def __init__(self, root: str):
        self.store, self.books = Store(root), {}
        with self.store.open("meta.json") as f:
            self.meta = json.loads(bytes(f.read()))
        self.made, self.layout = set(self.meta["made"]), Layout(self.meta["shards"], np.array(self.meta["layout"], np.uint64))
        self.hot = {int(np.int64(h).view(np.uint64)): (n, mass) for h, n, mass in self.meta["hot"]}
        self.floor = self.meta["tokens"] + 0.5 * (self.meta["words"] + 1)

    def _answer(self, k: int, asked: list[Asked]) -> None:
        """Look up what the blocks ask of a shard, all at once."""
        s = Shard(self.store.mapped(f"trie/{k:06d}.bin"))
        if k not in self.books:
            self.books[k] = 10.0 ** s.arrays["codes.book"], s.discount, 10.0 ** s.arrays["codes3.book"], s.discount3
        at, count, many = s.words(np.concatenate([x.known[x.cut0[k]:x.cut0[k + 1]] for x in asked]))
        done = 0
        for x in asked:
            n = x.cut0[k + 1] - x.cut0[k]
            x.count[x.cut0[k]:x.cut0[k + 1]], x.mass[x.cut0[k]:x.cut0[k + 1]] = count[done:done + n], s.discount * many[done:done + n]
            done += n
        own, own3 = [x.order[x.cut[k]:x.cut[k + 1]] for x in asked], [x.order3[x.cut3[k]:x.cut3[k + 1]] for x in asked]
        context = np.concatenate([x.known[x.a[i]] for x, i in zip(asked, own)])
        first = _runs(context)
        owner = np.repeat(s.contexts.find(context[first]), np.diff(np.append(first, len(context))))
        place, code, many = s.successors(owner, np.concatenate([x.known[x.b[i]] for x, i in zip(asked, own)]) >> _LOW)
        done, owner3 = 0, []
        for x, i, j in zip(asked, own, own3):
            x.code[i], x.many[i] = code[done:done + len(i)], many[done:done + len(i)]
            owner3.append(place[done:done + len(i)][np.searchsorted(i, x.pair[j])])
            done += len(i)
        code3 = s.last(np.concatenate(owner3), np.concatenate([x.known[x.w[j]] for x, j in zip(asked, own3)]) >> _LOW)
        done = 0
        for x, j in zip(asked, own3):
            x.code3[j] = code3[done:done + len(j)]
            done += len(j)

    def _scored(self, x: Asked) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text of a block whose questions are answered."""
        known, count, mass = x.known, x.count, x.mass
        for i in np.flatnonzero(self.layout.is_hot(known)).tolist():
            count[i], mass[i] = self.hot.get(int(known[i]), (0, 0.0))
        share = np.divide(mass, count, out=np.ones(len(known)), where=count > 0)
        # As a token, the end occurs as often as the start does as a context.
        start, end = np.searchsorted(known, np.array([_hash(START), _hash(END)], np.uint64))
        occurs = count.copy()
        occurs[end], occurs[start] = count[start], 0
        p1 = (occurs + 0.5) / self.floor
        pairs, triples = len(x.a), len(x.pair)
        kept2, count2, kept3, rest3 = np.zeros(pairs), np.zeros(pairs), np.zeros(triples), np.ones(triples)
        for k in np.flatnonzero(np.diff(x.cut)).tolist():
            if k in self.books:
                book, discount, book3, discount3 = self.books[k]
                own, own3 = x.order[x.cut[k]:x.cut[k + 1]], x.order3[x.cut3[k]:x.cut3[k + 1]]
                there = own[x.many[own] >= 0]
                kept2[there] = book[x.code[there]]
                count2[there] = kept2[there] + discount
                there = own3[x.code3[own3] >= 0]
                kept3[there] = book3[x.code3[there]]
                rest3[own3] = discount3 * x.many[x.pair[own3]]
        total = count[x.a]
        p2 = np.divide(kept2, total, out=np.zeros(pairs), where=total > 0) + share[x.a] * p1[x.b]
        follows = np.ones(len(x.of), bool)
        follows[x.starts] = False
        below = np.zeros(triples)
        below[x.triple_of] = p2[x.of[follows]]
        whole = count2[x.pair]
        seen = (whole > 0) & (x.many[x.pair] > 0)
        p3 = np.where(seen, np.divide(kept3 + rest3 * below, whole, out=np.zeros(triples), where=whole > 0), below)
        logs = np.log10(p2)[x.of]
        logs[follows] = np.log10(p3)[x.triple_of]
        tokens = x.b[x.of]
        return {
            "n_tokens": x.ends - x.starts, "n_known": np.add.reduceat((occurs > 0)[tokens].astype(np.int64), x.starts),
            "base_score": np.add.reduceat(np.log10(p1)[tokens], x.starts), "score": np.add.reduceat(logs, x.starts),
        }

    def scores(self, asked: list[Asked]) -> Iterator[dict[str, np.ndarray]]:
        """The scores of each block; each file is mapped once for all of them."""
        for k in np.flatnonzero(np.any([x.shards() for x in asked], axis=0)).tolist():
            if k in self.made:
                self._answer(k, asked)
        return map(self._scored, asked)

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        return next(self.scores([Asked(texts, self.layout)]))


def score(docs: DataFrame, root: str, text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """The columns in keep, n_tokens, n_known, train_tokens, base_score and score for each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, asked, kept, size = Trie(root), [], [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            for got, columns in zip(trie.scores(asked), kept):
                n = np.full(len(got["score"]), trie.meta["tokens"], np.int64)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(got["n_tokens"]), pa.array(got["n_known"]), pa.array(n), pa.array(got["base_score"]), pa.array(got["score"])], names=[*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        for b in blocks(batches, 0, BLOCK_BYTES):
            more = b.column(0).nbytes
            if asked and size + more > GROUP_BYTES:
                yield from scored()
                asked, kept, size = [], [], 0
            asked.append(Asked(b.column(0), trie.layout))
            kept.append(b.columns[1:])
            size += more
        if asked:
            yield from scored()
        asked.clear()
        del trie
        release_memory()

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens long, n_known long, train_tokens long, base_score double, score double"]))


def op4_elias_fano_trie(spark: SparkSession, root: str) -> DataFrame:
    """The log-probability of each document under a trie learned from those whose id isn't held out."""
    docs, at = table(spark, root, "documents"), work_folder(spark, "trie")
    out = held_out(F.col("doc_id"), 5, 1)
    fit(docs.where(~out), at)
    return score(docs.select("doc_id", out.alias("held_out"), "text"), at, keep=["doc_id", "held_out"])
