"""Text as flat byte arrays inside tasks, and the few helpers the operators share.

A batch of rows reaches Python as one Arrow buffer of UTF-8 bytes with offsets. Words, hashes and spans
are computed on that buffer with numpy, in slices of bounded size; no Python string is made per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Word bytes are the digits, the letters and every byte of a character beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all others (the splitmix finish)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as they were needed."""

    base = 0xD6E8FEB86659FD93
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, SLICE_BYTES + 2)
            cls.up, cls.down = _powers(cls.base, n), _powers(pow(cls.base, -1, 1 << 64), n)
        return cls.up, cls.down


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; a longer row comes alone."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, words before each row) of consecutive rows."""
    low = _LOWER[data]
    n = len(low)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _WORD[low]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # where a row begins, a word begins too
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | first[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | first[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def span_hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes have equal hashes wherever they stand."""
    up, down = _Powers.of(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE[low] * up[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold complete runs of equal keys, from batches sorted by that key."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last == 0 and kept and kept[-1].column(kept[-1].schema.get_field_index(key))[-1].as_py() == keys[-1]:
            kept.append(batch)
            continue
        if kept or last:
            yield pa.Table.from_batches([*kept, batch.slice(0, last)])
        kept = [batch.slice(last)]
    if kept:
        yield pa.Table.from_batches(kept)


_SENT: set[str] = set()


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow for functions of this package, which is sent to the executors: they need not have it installed.

    Spark counts rows for a batch and allows 64 MB; unless the session says otherwise, it is told to end batches
    at BATCH_BYTES, so that a task holds little at a time whatever the length of the texts.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) is None:
        conf.set(limit, str(BATCH_BYTES))
    context = df.sparkSession.sparkContext
    if context.applicationId not in _SENT:
        root = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="package-"), "chartline.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(root.joinpath("chartline").rglob("*.py")):
                out.write(source, source.relative_to(root))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)
    return df.mapInArrow(tidy(run), schema)


def release() -> None:
    """Give memory that arrays no longer use back to the system: Spark keeps Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """A mapInArrow function that releases memory after each batch and at its end."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            release()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts(batches))
        release()

    return wrapped


def durable(spark: SparkSession) -> None:
    """checkpoint() needs a folder that all executors share; the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and the master is this machine, as in a test, a folder of its own is set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)


def saved(df: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder: computed once, and safe when executors are lost."""
    durable(df.sparkSession)
    return df.checkpoint()


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it of a folder named by a path or URI."""
    if folder.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(folder)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a folder of this package's own tables, in whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared checkpoint folder: computed once, read by columns."""
    durable(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


BLOOM_BITS = 1 << 27


class Bloom:
    """A Bloom filter over 64-bit hashes: a shuffle is spared for rows that it does not hold.

    It is sized for the hashes counted, up to BLOOM_BITS (16 MB), and is built in parts by the tasks. Beyond
    that it lets more rows through by chance; what it holds it never denies. An exact join follows it.
    """

    def __init__(self, hashes: DataFrame):
        """hashes: one column of 64-bit hashes."""
        n = hashes.count()
        self.bits = min(BLOOM_BITS, max(1 << 12, 1 << (16 * n).bit_length()))
        bits = self.bits

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            line = np.zeros(bits, bool)
            for batch in batches:
                for at in Bloom.places(batch.column(0).to_numpy(), bits):
                    line[at] = True
            packed = np.packbits(line, bitorder="little").view("<i8")
            word = np.flatnonzero(packed)
            for k in range(0, len(word), 1 << 16):
                some = word[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(packed[some])], names=["word", "bits"])

        found = mapped(hashes, parts, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        line = np.zeros(bits // 64, "<i8")
        line[found.column("word").to_numpy()] = found.column("bits").to_numpy()
        self.sent = hashes.sparkSession.sparkContext.broadcast(line.view(np.uint8))

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        x = hashes.astype(np.int64).view(np.uint64)
        for k in range(4):
            yield (mix(x + np.uint64(k + 1) * _ODD) & np.uint64(bits - 1)).astype(np.int64)

    def rows(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of df whose hash may be held, all columns."""
        sent, bits = self.sent, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            line = sent.value
            for batch in batches:
                held = np.ones(batch.num_rows, bool)
                for at in Bloom.places(batch.column(batch.schema.get_field_index(column)).to_numpy(), bits):
                    held &= line[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
                if held.any():
                    yield batch.filter(pa.array(held))

        return mapped(df, run, df.schema)
