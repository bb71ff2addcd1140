"""Token-ID output: a content-addressed store.

Each text is encoded, an end id is appended, and a rolling hash over the ids cuts the stream into chunks, so equal
passages give equal chunks wherever they stand. A chunk is named by the SHA-256 of its ids and kept once. The store:

    packs/P.bin       unique chunks (zstd over little-endian ids), one after the other
    index/            Parquet: digest, pack, offset, length
    recipes/part=K/   Parquet, parts and rows in ascending doc_id order: doc_id, start, n_tokens, rank in its part, the chunks, the leaf
    manifest/         Parquet: for each part of the recipes, the root of a Merkle tree over its leaves, and their number
    root.json         the root over all parts, the width of an id, the end id, the number of ids

Encoding runs once, inside the scan's tasks, without moving texts: tasks write staging packs, a groupBy over chunk names
(some 40 bytes each) names one copy of each chunk, and a second pass keeps only those. A leaf is the hash of doc_id, start,
n_tokens and the chunks' names. Reading follows the recipes and checks each chunk against its name and each document against
its leaf; verify_store rebuilds the roots from the recipes as stored, by levels of FAN leaves, so that no part is gathered.

Defined results: a null or empty text is the end id alone. Null doc_ids come first. Repeated doc_ids each have their own
recipe, in order of arrival. An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import Store, blocks, drop_folder, release_memory, small_batches, stored, tasks, work_folder

#: Ids in a chunk: least, on average past that, most.
LEAST, MEAN, MOST = 256, 1024, 8192
#: A task holds a pack until it is written.
PACK_BYTES = 16 << 20
#: Children of a node of the Merkle tree.
FAN = 1024
#: Words whose ids a worker remembers, within a task: if there are more, the half that was used last stays.
CACHE = 150_000
#: Words, and bytes of whole texts, that go to the tokenizer in one call, which holds some 200 bytes for each of their ids; bytes of
#: texts encoded at a time; ids of documents read at a time, a quarter of them where they are given too.
CALL, CALL_BYTES, BLOCK_BYTES, READ_IDS = 1 << 12, 1 << 18, 3 << 19, 1 << 20
#: White space in any sense, the space and the line end apart: a text with it is encoded as it is.
_ODD = "[\\t\\x{0b}\\f\\r\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A letter and marks at the end: the pre-tokenizer always cuts between the two.
_MARKS, _TAIL = ".,;:!?", "[A-Za-zÀ-ÖØ-öø-ÿ][.,;:!?]{1,4}$"


class _Words:
    """Ids of words, as bytes, each after the same sign: those used last are remembered, in Arrow arrays, which take a tenth of a dict's memory."""

    def __init__(self, encode):
        self.encode = encode
        self.forget()

    def ids(self, words: pa.Array) -> pa.Array:
        """The ids of distinct words."""
        at = pc.index_in(words, value_set=self.words)
        new = words.filter(at.is_null())
        self.turn += 1
        self.used[at.drop_null().to_numpy()] = self.turn
        if len(new):
            first = len(self.words)
            self.words = pa.concat_arrays([self.words, new])
            self.found = pa.concat_arrays([self.found, pa.array(self.encode(new.to_pylist()), pa.large_binary())])
            self.used = np.append(self.used, np.full(len(new), self.turn))
            place = at.to_numpy(zero_copy_only=False).copy()
            place[np.isnan(place)] = np.arange(first, len(self.words))
            at = pa.array(place.astype(np.int64))
        out = self.found.take(at)
        if len(self.words) > CACHE:
            keep = pa.array(np.sort(np.argsort(self.used, kind="stable")[-(CACHE // 2):]))
            self.words, self.found, self.used = self.words.take(keep), self.found.take(keep), self.used[keep.to_numpy()]
        return out

    def forget(self) -> None:
        self.words, self.found, self.used, self.turn = pa.array([], pa.string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64), 0


class Encoder:
    """Ids of whole texts, as bytes. A byte-level pre-tokenizer starts a new piece at each space before a visible character and
    at each line end, and one after it; so texts are cut there and each distinct word is encoded once, many in a call. Texts
    that might be cut otherwise (other white space, several spaces or empty lines, literals of added tokens) are encoded as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        conf = json.loads(self.tokenizer.to_str())
        kind = conf.get("pre_tokenizer") or {}
        self.by_piece = kind.get("type") == "ByteLevel" and kind.get("use_regex", False) and not kind.get("add_prefix_space", True) and not conf.get("normalizer")
        self.literals = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if self.by_piece:
            vocab = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocab.values()) + 1, bool)  # ids of tokens that start with a space
            self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
            self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
            self.after_space, self.after_line = _Words(lambda w: self._joined(w, " ", 0)), _Words(lambda w: self._joined(w, "\n", self.dtype.itemsize))
            self.tails = _Words(self._whole)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, texts: pa.Array) -> pa.Array:
        """The ids of texts that are encoded as they are, CALL_BYTES in one call."""
        few = blocks([pa.RecordBatch.from_arrays([texts], names=["text"])], 0, CALL_BYTES)
        return pa.array([x for b in few for x in self._whole(b.column(0).to_pylist())], pa.large_binary())

    def _joined(self, words: list[str], mark: str, skip: int) -> list[bytes]:
        """The ids of words, each after mark, without the first `skip` bytes; CALL words in one call: the ids tell where each starts."""
        if len(words) > CALL:
            return [x for i in range(0, len(words), CALL) for x in self._joined(words[i:i + CALL], mark, skip)]
        data, w = self._whole([mark + mark.join(words)])[0], self.dtype.itemsize
        ids = np.frombuffer(data, self.dtype)
        starts = np.flatnonzero(self.opens[ids] if mark == " " else ids == self.line) * w
        return [data[a + skip:z] for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(data)])]

    def _pieces(self, pieces: pa.Array, words: _Words) -> pa.Array:
        """The ids of visible pieces: those of what stands before their last marks, then those of the marks."""
        pieces = pieces.cast(pa.string())
        cut = pc.match_substring_regex(pieces, _TAIL)
        heads = pc.if_else(cut, pc.utf8_rtrim(pieces, characters=_MARKS), pieces)
        coded = heads.dictionary_encode()
        out = words.ids(coded.dictionary).take(coded.indices)
        length = (pc.binary_length(pieces).to_numpy() - pc.binary_length(heads).to_numpy()).astype(np.int64)
        tails, place = [b""], np.zeros(len(pieces), np.int64)
        for n in range(1, 5):
            at = np.flatnonzero(length == n)
            if len(at):
                own = pc.utf8_slice_codeunits(pieces.take(pa.array(at)), start=-n).dictionary_encode()
                place[at] = len(tails) + own.indices.to_numpy()
                tails += self.tails.ids(own.dictionary).to_pylist()
        return pc.binary_join_element_wise(out, pa.array(tails, pa.large_binary()).take(pa.array(place)), pa.scalar(b"", pa.large_binary()))

    def forget(self) -> None:
        """Workers outlive tasks: what one remembered mustn't take memory from the next stage's."""
        if self.by_piece:
            for x in (self.after_space, self.after_line, self.tails):
                x.forget()
        release_memory()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and where each text's ids end. Arrow cuts texts, numbers the distinct
        pieces and strings their ids together; Python sees each distinct word once a block."""
        texts = texts.fill_null("").cast(pa.string())
        n, w, end = len(texts), self.dtype.itemsize, np.array([end_id], self.dtype).tobytes()
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        slow = np.ones(n, bool)
        if self.by_piece:
            slow = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
            for x in self.literals:
                slow = slow | pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        # A line end opens the piece that it stands before; a piece without it stood after a space.
        lists = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(slow), "", texts), "\n", " \n"), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = lists.flatten().dictionary_encode()
        index, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        first = np.zeros(len(index), bool)
        first[offsets[:-1]] = True
        # Empty pieces (after several spaces) and empty lines that follow each other are cut otherwise.
        bare, empty = (pc.equal(pieces, x).to_numpy(zero_copy_only=False)[index] for x in ("\n", ""))
        bad = empty & ~first
        bad[1:] |= bare[1:] & bare[:-1] & ~first[1:]
        slow |= np.maximum.reduceat(bad, offsets[:-1])
        lined = pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        after = np.zeros(len(pieces), bool)  # pieces that stand after something
        after[index[~first]] = True
        if self.by_piece:
            parts, place = [], np.zeros(len(pieces), np.int64)
            at = np.flatnonzero(after & ~lined & (pc.binary_length(pieces).to_numpy() > 0))
            place[at] = np.arange(len(at))
            parts.append(self._pieces(pieces.take(pa.array(at)), self.after_space))
            own = np.flatnonzero(lined)
            place[own] = len(at) + np.arange(len(own))
            rest = pc.utf8_slice_codeunits(pieces.take(pa.array(own)), start=1)
            some = pc.binary_length(rest).to_numpy() > 0
            line = pa.array([np.array([self.line], self.dtype).tobytes()], pa.large_binary())[0]
            ids = pa.array([b""], pa.large_binary()).take(pa.array(np.zeros(len(own), np.int64)))
            if some.any():
                ids = pc.replace_with_mask(ids, pa.array(some), self._pieces(rest.filter(pa.array(some)), self.after_line))
            parts.append(pc.binary_join_element_wise(line, ids, pa.scalar(b"", pa.large_binary())) if len(own) else ids)
            # Each text's first piece stands after nothing, as one after a line end does.
            opening = pieces.take(pa.array(index[offsets[:-1]])).dictionary_encode()
            words = opening.dictionary
            some = pc.binary_length(words).to_numpy() > 0
            known = pa.array([b""], pa.large_binary()).take(pa.array(np.zeros(len(words), np.int64)))
            if some.any():
                known = pc.replace_with_mask(known, pa.array(some), self.after_line.ids(words.filter(pa.array(some))))
            opened = known.take(opening.indices)
            size = len(at) + len(own)
        else:
            parts, place, size, opened = [], np.zeros(len(pieces), np.int64), 0, pa.array([b""] * n, pa.large_binary())
        at = np.flatnonzero(slow)
        if len(at):
            opened = pc.replace_with_mask(opened, pa.array(slow), self._alone(texts.take(pa.array(at))))
        every = pa.concat_arrays([*parts, opened, pa.array([end], pa.large_binary())])
        index = place[index]
        index[offsets[:-1]] = size + np.arange(n)
        keep = first | ~np.repeat(slow, np.diff(offsets))
        counts = np.add.reduceat(keep, offsets[:-1], dtype=np.int64)
        index = np.insert(index[keep], np.cumsum(counts), len(every) - 1)
        got = every.take(pa.array(index))
        where = np.frombuffer(got.buffers()[1], np.int64)[got.offset:got.offset + len(got) + 1]
        return np.frombuffer(got.buffers()[2], self.dtype)[where[0] // w:where[-1] // w], (where[np.cumsum(counts + 1)] - where[0]) // w


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cuts(ids: np.ndarray, ends: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[list[int]]:
    """For each document (ids up to each of ends), where its chunks end. A cut depends on the 16 ids before it and on the
    distance to the cut before; it never looks across a document's start."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    for k in (1, 2, 4, 8):
        up = h.copy()
        up[k:] += h[:-k] << np.uint32(k)
        h = up
    places = np.flatnonzero(h >> np.uint32(32 - int(np.log2(mean))) == 0) + 1
    out, a = [], 0
    bounds = np.searchsorted(places, np.concatenate(([0], ends)), "right")
    for n, z in enumerate(ends.tolist()):
        own, at = [], a
        for p in places[bounds[n]:bounds[n + 1]].tolist():
            if p - a < 16 or p >= z:
                continue
            while p - at > most:
                at += most
                own.append(at)
            if p - at >= least:
                at = p
                own.append(at)
        while z - at > most:
            at += most
            own.append(at)
        own.append(z)
        out.append(own)
        a = z
    return out


_RECIPE = "row long, doc_id {}, n_tokens long, chunks array<struct<digest:binary,pack:string,offset:long,length:int,n:int>>"


def _top(roots: list[str]) -> str:
    return hashlib.sha256("".join(roots).encode()).hexdigest()


def _roots(leaves: DataFrame, most: int) -> DataFrame:
    """part, root, docs from leaves (part, rank from 1, leaf): each FAN neighbours become one node, until a part has one."""
    level, counts = leaves.select("part", (F.col("rank") - 1).alias("at"), "leaf"), leaves.groupBy("part").agg(F.count("*").alias("docs"))
    while True:
        node = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "leaf"))), lambda x: x["leaf"]), "")
        level = level.groupBy("part", F.floor(F.col("at") / FAN).alias("at")).agg(F.sha2(node, 256).alias("leaf"))
        most = -(-most // FAN)
        if most <= 1:
            return level.select("part", F.col("leaf").alias("root")).join(counts, "part")


def _packer(root: str, tokenizer: str, end_id: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        enc, store, part = encoder(tokenizer), Store(root), TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=1)
        known: dict[bytes, tuple[str, int, int]] = {}
        held: list[bytes] = []
        size, pack, row = 0, 0, part << 33
        name = f"{part:06d}-{pack:03d}"
        for b in blocks(batches, 1, BLOCK_BYTES):
            flat, ends = enc.encode(b.column(1), end_id)
            data, w = flat.tobytes(), enc.dtype.itemsize
            digests, packs, starts, lengths, sizes, per, a = [], [], [], [], [], [], 0
            for own in cuts(flat, ends) if len(ends) else []:
                for z in own:
                    raw = data[a * w:z * w]
                    digest = hashlib.sha256(raw).digest()
                    if digest not in known:
                        packed = press.compress(raw)
                        known[digest] = (name, size, len(packed))
                        held.append(packed)
                        size += len(packed)
                    p, o, n = known[digest]
                    digests.append(digest)
                    packs.append(p)
                    starts.append(o)
                    lengths.append(n)
                    sizes.append(z - a)
                    a = z
                per.append(len(own))
                if size >= PACK_BYTES:
                    store.write(f"staging/{name}.bin", held)
                    held, size, pack = [], 0, pack + 1
                    name = f"{part:06d}-{pack:03d}"
            n_tokens = np.diff(ends, prepend=0)
            kind = schema.field(3).type
            columns = [pa.array(x, kind.value_type.field(k).type) for k, x in enumerate((digests, packs, starts, lengths, sizes))]
            recipes = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *per]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type))).cast(kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(ends))), b.column(0), pa.array(n_tokens), recipes], schema=schema)
            row += len(ends)
        if held:
            store.write(f"staging/{name}.bin", held)
        enc.forget()

    return run


def _keeper(root: str):
    """Of a staging pack, keep the chunks that are the named copies."""
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        store, g = Store(root), g.sort_values("offset")
        name, at, parts, where = g["pack"].iloc[0], 0, [], []
        with store.open(f"staging/{name}.bin") as f:
            for o, n in zip(g["offset"].tolist(), g["length"].tolist()):
                f.seek(o)
                parts.append(f.read(n))
                where.append(at)
                at += n
        store.write(f"packs/{name}.bin", parts)
        del parts
        release_memory()
        return g.assign(offset=where)[["digest", "pack", "offset", "length"]]

    return run


def write_store(docs: DataFrame, root: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode docs into a store at root (a folder in the shared store); gives the Merkle root in hex."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ddl = _RECIPE.format(kind)
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)
    first = stored(rows.mapInArrow(_packer(root, tokenizer, end_id, schema), ddl), f"{root}/staging_recipes")
    chunks = first.select(F.explode("chunks").alias("c")).select("c.*")
    named = chunks.groupBy("digest").agg(F.min(F.struct("pack", "offset", "length")).alias("at")).select("digest", "at.*")
    index = stored(named.groupBy("pack").applyInPandas(_keeper(root), "digest binary, pack string, offset long, length int"), f"{root}/index")
    drop_folder(spark, f"{root}/staging")

    # Recipes point at the kept copies, in order of doc_id, each with the number of ids before it.
    placed = (
        first.select("row", F.posexplode("chunks").alias("k", "c")).select("row", "k", "c.digest", "c.n")
        .join(index, "digest").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "digest", "pack", "offset", "length", "n"))).alias("chunks"))
    )
    ordered = first.drop("chunks").join(placed, "row")
    ordered = ordered.repartitionByRange(tasks(spark), "doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    parts = stored(ordered, f"{root}/unplaced")
    total = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    before = parts.groupBy("part").agg(F.sum("n_tokens").alias("ids")).withColumn("before", F.coalesce(F.sum("ids").over(total), F.lit(0))).drop("ids")
    within = Window.partitionBy("part").orderBy("doc_id", "row")
    recipes = parts.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).drop("before")
    recipes = recipes.withColumn("rank", F.row_number().over(within)).withColumn("leaf", _leaf())
    recipes.sortWithinPartitions("part", "doc_id", "row").write.partitionBy("part").parquet(f"{root}/recipes")
    recipes = spark.read.schema(recipes.schema).parquet(f"{root}/recipes")
    counts = recipes.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids")).agg(F.max("n").alias("most"), F.sum("ids").alias("ids")).first()
    manifest = stored(_roots(recipes.select("part", "rank", "leaf"), counts["most"] or 0), f"{root}/manifest")
    whole = _top([r["root"] for r in manifest.orderBy("part").collect()])  # one row for each part: as many as shuffle partitions
    Store(root).write("root.json", [json.dumps({"root": whole, "dtype": encoder(tokenizer).dtype.str, "end_id": end_id, "ids": counts["ids"] or 0, "recipes": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in recipes.schema)}).encode()])
    for x in ("staging_recipes", "unplaced"):
        drop_folder(spark, f"{root}/{x}")
    return whole


def _leaf():
    own = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "start", "n_tokens")]
    return F.sha2(F.concat_ws(":", *own, F.concat_ws("", F.transform("chunks", lambda c: F.hex(c["digest"])))), 256)


def _recipes(spark: SparkSession, root: str) -> DataFrame:
    with Store(root).open("root.json") as f:
        return spark.read.schema(json.loads(bytes(f.read()))["recipes"]).parquet(f"{root}/recipes")


def _runs(sizes: np.ndarray, most: int = READ_IDS) -> Iterator[tuple[int, int]]:
    """Runs of rows of `most` ids at most, or of one row where it has more."""
    done, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(done, done[a] - sizes[a] + most, "right")))
        yield a, z
        a = z


def read_store(spark: SparkSession, root: str, with_ids: bool = True) -> DataFrame:
    """Documents rebuilt from a store: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids. A chunk or document that
    doesn't match its hash stops the job."""
    from pyspark.sql.pandas.types import to_arrow_schema

    recipes = _recipes(spark, root).select("doc_id", "start", "n_tokens", F.when(_leaf() == F.col("leaf"), F.col("leaf")).alias("leaf"), F.transform("chunks", lambda c: c.dropFields("k")).alias("chunks"))
    ddl = f"doc_id {recipes.schema['doc_id'].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    schema = to_arrow_schema(spark.createDataFrame([], ddl).schema)

    def run(batches):
        import zstandard

        store, open_press = Store(root), zstandard.ZstdDecompressor()
        with store.open("root.json") as f:
            dtype = np.dtype(json.loads(bytes(f.read()))["dtype"])
        files: dict[str, object] = {}
        for b in (b.slice(a, z - a) for b in batches for a, z in _runs(b.column(2).to_numpy(), READ_IDS // 4 if with_ids else READ_IDS)):
            crc, all_ids = [], []
            for n, leaf, chunks in zip(*(c.to_pylist() for c in b.columns[2:])):
                raw = []
                for c in chunks:
                    if c["pack"] not in files:
                        if len(files) > 64:
                            files.pop(next(iter(files))).close()
                        files[c["pack"]] = store.open(f"packs/{c['pack']}.bin")
                    f = files[c["pack"]]
                    f.seek(c["offset"])
                    ids = open_press.decompress(f.read(c["length"]))
                    if hashlib.sha256(ids).digest() != c["digest"]:
                        raise ValueError(f"chunk {c['digest'].hex()} in {c['pack']} is damaged")
                    raw.append(ids)
                ids = np.frombuffer(b"".join(raw), dtype)
                if len(ids) != n or leaf is None:
                    raise ValueError("a recipe doesn't match its leaf")
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            cols = [b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(all_ids, pa.list_(pa.int32())).cast(schema.field(4).type))
            yield pa.RecordBatch.from_arrays(cols, schema=schema)
        release_memory()

    return recipes.mapInArrow(run, ddl)


def verify_store(spark: SparkSession, root: str) -> bool:
    """Whether the recipes as stored give the manifest's roots, and these the store's root."""
    manifest, recipes = spark.read.parquet(f"{root}/manifest"), _recipes(spark, root).select("part", "rank", _leaf().alias("leaf"))
    got = {r["part"]: r["root"] for r in manifest.collect()}  # one row for each part
    new = {r["part"]: r["root"] for r in _roots(recipes, manifest.agg(F.max("docs")).first()[0] or 0).collect()}
    with Store(root).open("root.json") as f:
        top = json.loads(bytes(f.read()))["root"]
    return new == got and _top([got[k] for k in sorted(got)]) == top


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_store(spark: SparkSession, root: str) -> DataFrame:
    """documents as token ids in a store in the shared folder, verified by its roots and read back from its files."""
    from loomspan.sources.tables import table

    at = work_folder(spark, "tokens")
    write_store(table(spark, root, "documents"), at, default_tokenizer())
    if not verify_store(spark, at):
        raise ValueError(f"the store at {at} doesn't match its root")
    return read_store(spark, at, with_ids=False)
