"""What the operators share: work folders in the cluster's shared store, file access from tasks, word patterns."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: A word is a longest run of characters other than space and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 8 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (as in tests) gets a folder
    of our own; on a cluster there is none to guess."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/loomspan-shared"
        spark.conf.set("spark.checkpoint.dir", root)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder name in the shared store. Nothing is made there yet."""
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex[:12]}"


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read back: its lineage ends at files that outlive any executor."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound what one Arrow batch may hold, so that long texts don't fill a Python worker; a smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key)).removesuffix("b")
    spark.conf.set(key, str(min(most, int(now)) if now.isdigit() and int(now) > 0 else most))


def release_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nobody holds any more: Spark removes them when their plans are collected."""
    gc.collect()
    spark._jvm.System.gc()


def tasks(spark: SparkSession) -> int:
    """How many partitions a shuffle gets."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks(batches: Iterator, column: int, most: int) -> Iterator:
    """The rows of Arrow batches, in runs of at most this many bytes of column, or of one row where that is longer."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        size = pc.binary_length(b.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        done, a = np.cumsum(size), 0
        while a < len(size):
            z = max(a + 1, int(np.searchsorted(done, done[a] - size[a] + most, "right")))
            yield b.slice(a, z - a)
            a = z


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Store:
    """Files in the shared store, as a task sees them: plain files where the store is a mounted folder, else by pyarrow's file systems."""

    def __init__(self, root: str):
        url = urlparse(root)
        self.local = url.scheme in ("", "file")
        if self.local:
            self.fs, self.root = None, url.path
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, name: str, parts) -> None:
        """Write a file as a whole or not at all; a second attempt of a task replaces it by the same bytes."""
        to, tmp = self.path(name), self.path(f"{name}.{uuid.uuid4().hex[:8]}.tmp")
        if self.local:
            os.makedirs(os.path.dirname(to), exist_ok=True)
        else:
            self.fs.create_dir(os.path.dirname(to), recursive=True)
        try:
            with open(tmp, "wb") if self.local else self.fs.open_output_stream(tmp) as f:
                for x in parts:
                    f.write(x)
            os.replace(tmp, to) if self.local else self.fs.move(tmp, to)
        except BaseException:
            with contextlib.suppress(OSError):
                os.remove(tmp) if self.local else self.fs.delete_file(tmp)
            raise

    def open(self, name: str):
        """A file to seek and read in."""
        return open(self.path(name), "rb") if self.local else self.fs.open_input_file(self.path(name))

    def mapped(self, name: str):
        """A file's bytes, memory-mapped. Where the store is no mounted folder, from a copy that lives as long as its map."""
        import numpy as np

        if self.local:
            return np.memmap(self.path(name), np.uint8, "r")
        with tempfile.TemporaryFile() as f, self.open(name) as source:
            while part := source.read(8 << 20):
                f.write(part)
            f.flush()
            return np.memmap(f, np.uint8, "r")
