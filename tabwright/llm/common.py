"""Shared plumbing: durable intermediate tables, column hygiene and vectorised word hashing."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java character class of one word: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only a session that names none, such as
    a test's local one, gets a temporary folder of this machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by driver and executors")
        found = "file://" + tempfile.mkdtemp(prefix="tabwright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold fewer rows than usual, where the session does not say how many: rows are whole
    documents here, and each task holds a batch on both sides, beside the executor's heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, "1000")


class Scratch:
    """Intermediate tables of one piece of work, in a folder of their own below the shared one.

    ``drop`` deletes them and nothing else. A lazy result reads its tables until it has been written,
    so whoever writes it may drop the scope; used as a context manager, a scope ends with its block.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark, self.count = spark, 0
        self.root = f"{shared_dir(spark)}/tabwright-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage by writing a table to the shared folder and reading it again.

        A later stage that loses an executor rereads these files instead of recomputing, and what
        was written cannot differ between two reads.
        """
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def child(self) -> Scratch:
        """A scope inside this one: it can be dropped earlier, and goes with it at the latest."""
        inner = Scratch(self.spark)
        inner.root = self.path("scope")
        return inner

    def drop(self) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()


def quoted(name: str) -> Column:
    """Column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names for added columns that no column of the input has: those given, lengthened where they clash."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def local_path(uri: str) -> str:
    """Path of a folder that every machine mounts; other file systems cannot be memory-mapped."""
    found = urlparse(uri)
    if found.scheme not in ("", "file"):
        raise ValueError(f"flat binary files need a mounted shared folder, not {uri}")
    return unquote(found.path) if found.scheme else uri


def text_of(column: str = "text") -> Column:
    """The text, a null being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the words of a text; empty for a text without any."""
    return F.filter(F.split(text, SPACE_RUN), lambda w: w != "")


# ---------------------------------------------------------------- vectorised words (Arrow side)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 1 << 22:  # a longer one, for a giant text, is not kept
            _powers[base] = table
    return table[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of several texts: byte spans, text index, and (on demand) 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        """data: UTF-8 bytes of all texts; offsets: where each begins, and the end of the last."""
        self.data, self.offsets, self.lower = data, offsets, lower
        space = _IS_SPACE[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = space[:-1]
        inner = offsets[(offsets >= 0) & (offsets < len(data))]
        edge[inner] = True
        if len(data):
            self.start = np.flatnonzero(edge[:-1] & ~space)
            after = np.ones(len(data), bool)
            after[:-1] = space[1:]
            cut = inner[inner > 0] - 1
            after[cut] = True
            self.end = np.flatnonzero(after & ~space) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        #: first word of each text, and the number of all words
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        data = _LOWER[self.data] if self.lower else self.data
        coded = _BYTE_CODE[data]
        coded *= _power_table(_BASE, len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(coded, out=total[1:])
        raw = (total[self.end] - total[self.start]) * _power_table(_INVERSE, len(data) + 1)[self.start]
        return mix64(raw + (self.end - self.start).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles, and where those of each text begin (and the last end).

        A text with fewer words than k has one shingle, of all its words; one without words has none.
        """
        h, n = self.hashes(), self.counts
        many = np.maximum(n - k + 1, (n > 0).astype(n.dtype))
        bounds = np.concatenate([[0], np.cumsum(many)])
        if not bounds[-1]:
            return np.zeros(0, np.uint64), bounds
        first = np.repeat(self.bounds[:-1], many) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], many))
        size = np.repeat(np.minimum(n, k), many)
        padded = np.concatenate([h, np.zeros(k, np.uint64)])
        acc = size.astype(np.uint64)
        for j in range(k):
            step = mix64(acc * np.uint64(_BASE) + padded[first + j])
            acc = np.where(j < size, step, acc)
        return acc, bounds


#: What a worker keeps between tasks, and of which operator it is.
_KEPT: dict = {}
SLICE_BYTES = 1 << 20


def kept(owner: str) -> dict:
    """The worker's memory of an operator, such as a memo; another operator's goes."""
    if _KEPT.get("owner") != owner:
        _KEPT.clear()
        _KEPT["owner"] = owner
    return _KEPT


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable:
    """A function for mapInArrow with a small footprint: batches come in slices of bounded size, what other
    operators have left in the worker goes first, and freed memory returns to the machine at the end, as
    workers stay alive beside their executor's heap."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(owner)
        try:
            yield from run(sliced(batches))
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return walk


def text_chunks(column: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of an Arrow string column: first row, last row, UTF-8 bytes and offsets into them.

    A slice holds ``limit`` bytes at most unless it is one longer text, so that temporary arrays
    stay bounded however many rows a batch has. Nulls become empty texts.
    """
    column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(buffers[1], wide)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
