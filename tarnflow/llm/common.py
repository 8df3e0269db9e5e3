"""Helpers that the corpus operators share: shared-folder tables, text
normalisation on UTF-8 bytes, and 64-bit hashing with numpy."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

_SCRATCH: list[str] = []

#: ASCII letters lower-cased; every other ASCII byte that is neither a letter
#: nor a digit becomes a space; bytes of non-ASCII characters stay.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

MIX = np.uint64(0x9E3779B97F4A7C15)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a scratch table that are worth a file of their own.
FILE_ROWS = 200_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more partitions than they are worth:
    a small table is not scattered over hundreds of files."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    Cuts lineage like ``checkpoint()`` but computes the plan once, keeps the
    columns compressed and survives the loss of any executor. ``rows``: about so
    many at most, see ``compact``.
    """
    spark = df.sparkSession
    if rows is not None:
        df = compact(df, rows)
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _SCRATCH.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables() -> list[str]:
    """Paths of the scratch tables that exist."""
    return list(_SCRATCH)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete scratch tables, all or those given. Results that read them must
    have been written."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in scratch_tables() if paths is None else paths:
        if path in _SCRATCH:
            _SCRATCH.remove(path)
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


@atexit.register
def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession() if _SCRATCH else None
    if spark is not None:
        try:
            release(spark)
        except Exception:  # the JVM may be gone already
            _SCRATCH.clear()


def new_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores in front until ``df`` has none."""
    taken, out = {c.lower() for c in df.columns}, []
    for x in wanted:
        while x in taken:
            x = "_" + x
        out.append(x)
    return out


def bounded(df: DataFrame, most: int) -> DataFrame | None:
    """``df`` as a local table of the driver, to be broadcast, if it has at most
    ``most`` rows; otherwise None."""
    rows = df.limit(most + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= most else None


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_parts(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, list[bytes]]]:
    """A string column in parts (start, end, values as bytes) of about ``most``
    bytes, so that work space is bounded whatever the batch; a longer text is
    alone. Afterwards freed memory goes back to the system."""
    sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate([*sizes, most]):
        if size and (size + n > most or i == len(sizes)):
            yield start, i, utf8(column.slice(start, i - start))
            start, size = i, 0
        size += n + 64
    trim()


def trim() -> None:
    """Hand freed work space back to the system. Python workers outlive their
    tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return


def forget(*broadcasts) -> None:
    """Drop this worker's copies of large broadcast values; a later task that
    asks for one loads it again. An idle worker then holds none."""
    for b in broadcasts:
        vars(b).pop("_value", None)


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and non-ASCII."""
    return text.translate(WORD_TABLE).split()


def hash_words(words) -> np.ndarray:
    """64-bit hashes of byte strings."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter(map(h, words), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (two multiply-shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` consecutive values of ``h``."""
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * MIX + h[k : len(h) - n + 1 + k]
    return mix64(out)


def shingles_of(text: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a text of fewer words,
    but not none, is one shingle; a text without words has none."""
    h = hash_words(words_of(text))
    if not len(h):
        return h
    return np.unique(rolling(h, min(n, len(h))))
