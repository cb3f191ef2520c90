"""Helpers that the corpus operators share: scratch tables, word splitting, hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
SIMILARITY = 0.75

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a folder of its own; a cluster is
    refused, since no folder is known that all of its machines share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="terraquill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables of one operator call, written to the shared folder.

    A written table cuts the lineage: an executor lost later costs no recomputation.
    Tables go when the operator drops them. Those that a result still reads stay until the driver's JVM ends, which deletes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/terraquill/{name}-{uuid.uuid4().hex}"
        self.marked = False

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        if not self.marked:
            files, root = self._at("")
            self.marked = files.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        files, path = self._at(name)
        files.delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of the table has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER)
    )


def utf8(column: pa.Array) -> list[bytes | None]:
    """Texts of an Arrow column as UTF-8 bytes; ``bytes.split()`` and ``bytes.lower()`` then follow
    the ASCII rules of the contracts exactly."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in views of a few rows, so that a task holds only these rows as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: list[bytes], k: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of k words, in order; of the whole sequence if it has fewer words."""
    if not words:
        return np.empty(0, np.uint64)
    w = word_hashes(words)
    n, k = len(w), min(k, len(w))
    h = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ w[j : n - k + 1 + j]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return mix(h)


def multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit factors: each gives a permutation of the hash space."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bounded_broadcast(small: DataFrame, limit: int) -> DataFrame:
    """The table, marked for broadcast only if it is counted at no more than ``limit`` rows."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
