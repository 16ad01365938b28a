"""What the operators share: shared-folder tables, text buffers and word hashes."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Tables between jobs
# --------------------------------------------------------------------------


_held: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; only where that is unset and executors are threads of the driver, as in tests, a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[0-9*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidegate-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove_held() -> None:
    """At the program's end: the tables of this application, if its session still runs."""
    for path, spark in _held.items():
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # noqa: S112  the session is gone; what it left is its own folder
            continue


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends there, and a lost executor costs only tasks.

    Tables lie in a folder of their application, which goes when the program ends.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = f"{shared_folder(spark)}/tidegate-{spark.sparkContext.applicationId}"
    if not _held:
        atexit.register(_remove_held)
    _held[folder] = spark
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _scratches:
        _scratches[-1].append((path, out))
    return out


_scratches: list[list[tuple[str, DataFrame]]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables stored inside go at the end, but for those in the list that it gives: what is still to be read of an operator whose result is not."""
    kept: list[DataFrame] = []
    _scratches.append([])
    try:
        yield kept
    finally:
        for path, df in _scratches.pop():
            if any(df is k for k in kept):
                if _scratches:
                    _scratches[-1].append((path, df))
            else:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def doc_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns, clashing names among them, can't disturb an operator."""
    return df.select(*[df[n] for n in names])


#: Documents without doc_id are named by a hash of their text, above all doc_ids that are in use.
_UNNAMED = 1 << 62


def name_columns(documents: DataFrame) -> list[Column]:
    """`doc` and `version`: what names a document (its doc_id, or else its text), and which of the texts of that name it has."""
    text = F.coalesce(documents["text"], F.lit(""))
    return [F.coalesce(documents["doc_id"], F.lit(_UNNAMED) + F.shiftrightunsigned(F.xxhash64(text), 2)).alias("doc"), F.hash(text).alias("version")]


# --------------------------------------------------------------------------
# A filter of bounded size
# --------------------------------------------------------------------------


#: Parts of a bit map, each of which one task makes.
MAP_PARTS = 64


def bit_map(keys: DataFrame, bits: int) -> np.ndarray:
    """A bit for each `key` (64 bits), modulo `bits`, a power of two: a Bloom filter of one hash. What reaches the driver is the map, bits / 8 bytes at most."""
    span = max(64, bits // MAP_PARTS)

    def made(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for part in np.unique(at // span).tolist():
                own = (at[at // span == part] - part * span).astype(np.uint64)
                held = parts.setdefault(part, np.zeros(span // 64, dtype=np.uint64))
                np.bitwise_or.at(held, (own >> np.uint64(6)).astype(np.int64), np.uint64(1) << (own & np.uint64(63)))
        yield pa.record_batch([pa.array(list(parts), type=pa.int32()), pa.array([zstandard.compress(m.tobytes(), 1) for m in parts.values()], type=pa.binary())], names=["part", "packed"])

    # Distinct bits, so that no key's copies meet in one task; there are never more of them than bits.
    at = keys.select(F.pmod("key", F.lit(bits)).alias("at")).distinct()
    out = np.zeros(bits // 64, dtype=np.uint64)
    for r in at.repartition(MAP_PARTS, F.floor(F.col("at") / span)).mapInArrow(made, "part int, packed binary").collect():
        out[r.part * span // 64 : (r.part + 1) * span // 64] = np.frombuffer(zstandard.decompress(r.packed), dtype=np.uint64)
    return out


def in_bits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the map; those that are not, are not."""
    at = keys % np.uint64(64 * len(bits))
    return bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0


# --------------------------------------------------------------------------
# Text as bytes
# --------------------------------------------------------------------------

#: Bytes of text that are worked on at a time: the arrays beside them stay near the cache's size.
CHUNK_BYTES = 1 << 19


def byte_rows(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def chunks(rows: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `limit` bytes; a longer row stands alone."""
    start = held = 0
    for i, row in enumerate(rows):
        if held and held + len(row) > limit:
            yield start, i
            start, held = i, 0
        held += len(row) + 1
    if start < len(rows):
        yield start, len(rows)


#: Bytes of rows that reach a Python worker at a time, about: texts may be long, and workers share the executor's memory.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow's batches by bytes, where the session has Spark's own value."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if re.fullmatch(rf"{64 << 20}b?", spark.conf.get(key, "1")):
        spark.conf.set(key, str(BATCH_BYTES))


#: Rows that Spark's Parquet reader holds at a time: it has all their texts on the heap, in arrays that double until they fit.
READ_ROWS = 256


def small_reads(spark: SparkSession) -> None:
    """Bound the rows of the Parquet reader's batches, where the session has Spark's own value."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(key) == "4096":
        spark.conf.set(key, str(READ_ROWS))


#: Empty the tables that an operator keeps in a worker for its own next task there. Workers are used again by other operators.
worker_tables: list[Callable[[], None]] = []


def trimmed() -> None:
    """Give back what a worker holds for its next task, tables of other operators among it: idle workers share the executor's memory with others. An operator that keeps tables doesn't call it."""
    for empty in worker_tables:
        empty()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, names: list[str], schema: str, each: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over the named columns, batch by batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)
        trimmed()

    small_batches(df.sparkSession)
    return doc_columns(df, *names).mapInArrow(run, schema)


# --------------------------------------------------------------------------
# Words and their hashes
# --------------------------------------------------------------------------

_U = np.uint64
_rng = np.random.default_rng(20240229)
#: A random value for each byte, for the polynomial hash.
BYTE_VALUES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = _U(0x9E3779B97F4A7C15 | 5)
BASE_INVERSE = _U(pow(int(BASE), -1, 2**64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes: all but space and \x09-\x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes: ASCII letters and digits, and all that is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {}


def _power_table(kind: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        got = np.full(max(n, 2 * CHUNK_BYTES), base, dtype=np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if len(got) <= 4 * CHUNK_BYTES:
            _powers[kind] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Words:
    """The words of some rows: `starts` and `ends` in `buffer`, a 64-bit `hashes` value each, and `first`, where each row's words begin (one more entry than rows)."""

    __slots__ = ("buffer", "starts", "ends", "hashes", "first")

    def __init__(self, rows: list[bytes], word_bytes: np.ndarray, hashed: bool = True):
        self.buffer = np.frombuffer(b"\n" + b"\n".join(rows) + b"\n", dtype=np.uint8)
        is_word = word_bytes[self.buffer].view(np.int8)
        steps = np.diff(is_word)
        self.starts = np.flatnonzero(steps == 1) + 1
        self.ends = np.flatnonzero(steps == -1) + 1
        begins = np.cumsum([1] + [len(r) + 1 for r in rows])
        self.first = np.searchsorted(self.starts, begins)
        if hashed:
            values = BYTE_VALUES[LOWER[self.buffer]]
            n = len(values)
            values *= _power_table("up", BASE, n)[:n]
            sums = np.empty(n + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(values, out=sums[1:])
            self.hashes = mix((sums[self.ends] - sums[self.starts]) * _power_table("down", BASE_INVERSE, n)[self.starts])


_MULTIPLIERS = np.random.default_rng(77).integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k values; runs that cross a row's end are the caller's to leave out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = hashes[:n] * _MULTIPLIERS[0]
    for j in range(1, k):
        out += hashes[j : n + j] * _MULTIPLIERS[j]
    return mix(out + _U(k))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
