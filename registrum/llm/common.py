"""What the corpus operators share: reading, staging and Arrow access to text bytes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that a Python worker handles at once.
CHUNK = 1 << 20

_LOCAL_BASE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids give null."""
    return F.crc32(column.cast("string")) % n


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session runs in one local JVM and names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    if not _LOCAL_BASE:
        _LOCAL_BASE.append(tempfile.mkdtemp(prefix="registrum-"))
    return _LOCAL_BASE[0]


#: Shuffle files are removed as soon as the query that wrote them has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """df written once as a table in the shared folder and read back, which cuts its lineage; and the table's path. Shuffle files beneath it go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a staged table that no later plan reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def groups(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together have at most `most` bytes, or one longer text."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def freed() -> None:
    """Gives memory that Arrow and the C library keep back to the system; idle Python workers live on beside the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps less
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its worker's memory given back at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        freed()

    return wrapped


def appended(df: DataFrame, function, columns: str) -> DataFrame:
    """df with the columns that `function(batch) -> list[pa.Array]` makes of each Arrow batch. An input column of a new column's name gives way."""
    spark = df.sparkSession
    added = spark.createDataFrame([], columns).schema
    names = [f.name.lower() for f in added]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names])
    old = df.columns
    plain = df.toDF(*[f"c{k}" for k in range(len(old))])  # mapInArrow takes no names with dots
    schema = StructType([*plain.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = function(batch.rename_columns(old))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return plain.mapInArrow(releasing(run), schema).toDF(*old, *added.names)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE, _INVERSE = np.uint64(0x5851F42D4C957F2D), np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64; kept up to CHUNK."""
    if len(_POWERS[0]) >= n:
        return _POWERS
    made = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, CHUNK) - 1, b, np.uint64))]) for b in (_BASE, _INVERSE)]
    if n <= 2 * CHUNK:
        _POWERS[:] = made
    return made


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix64's finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte * base**position before each position, and the inverse powers: (sums[j] - sums[i]) * inverse[i] depends on the bytes i to j only."""
    powers, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    return sums, inverse


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) of the texts data[at[i]:at[i + 1]], and each text's first word and end."""
    base, data = int(at[0]), data[at[0] : at[-1]]
    inside = ~_SPACE[data]
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    edges = (at[:-1] - base)[np.diff(at) > 0]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    after[edges[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    sums, inverse = prefix_hash(_LOWER[data] if lower else data)
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, at - base)
