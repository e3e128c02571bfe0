"""Helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from ..shared import drop_table, table, unused  # noqa: F401  (the operators take them from here)

#: A word is a maximal run of characters other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def runs(df: DataFrame, words: str, width: int) -> tuple[DataFrame, str]:
    """Adds an array of the hashes of all runs of ``width`` elements of the array column ``words`` (longs); returns its name, too.

    Hashes of runs twice as long come from two of them, until two that overlap cover the width. Fewer elements: no run.
    """
    run, k = words, 1
    while k < width:
        step = min(k, width - k)
        (wider,) = unused(df.columns, f"{words}{k + step}")
        left = F.size(run) - step
        both = F.zip_with(F.slice(run, F.lit(1), left), F.slice(run, F.lit(1 + step), left), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn(wider, F.when(left > 0, both).otherwise(F.array().cast("array<long>")))
        run, k = wider, k + step
    return df, run


def shifted(name: str, a: Column, bits: Column) -> Column:
    """shiftleft, shiftright or shiftrightunsigned by a number of bits that is a column."""
    return F.call_function(name, a, bits)


def _digest_part(text: Column, part: int) -> Column:
    """64 bits of the SHA-256 digest of ``text`` as a long: the first (0), the second (1) and so on."""
    return F.conv(F.substring(F.sha2(text, 256), 16 * part + 1, 16), 16, -10).cast("long")


def row_key() -> list[Column]:
    """(did, fp): names a row of documents up to rows equal in id and text; never null. fp is cryptographic, as texts can be made whose plain hashes are equal."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(_digest_part(F.col("text"), 0)).alias("fp"),
    ]


def place_key() -> list[Column]:
    """(did, fp): as :func:`row_key`, but 128 bits of a digest of id and text, for joins that nothing compares afterwards."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return [_digest_part(both, i).alias(n) for i, n in enumerate(("did", "fp"))]


def row_digest(docs: DataFrame) -> Column:
    """SHA-256 of all columns of a row of ``docs``: rows with equal digests are equal rows."""

    def text(f) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (ArrayType, MapType, StructType)):
            return F.to_json(c)
        return F.hex(c) if isinstance(f.dataType, BinaryType) else c.cast("string")

    each = F.struct(*(text(f).alias(f"c{i}") for i, f in enumerate(docs.schema.fields)))
    return F.unhex(F.sha2(F.to_json(each), 256))


def secret() -> bytes:
    """A key for :func:`keyed_hashes`, new for each run: no texts can be made beforehand whose hashes are equal."""
    return secrets.token_bytes(16)


def keyed_hashes(values: Iterable[bytes], key: bytes) -> np.ndarray:
    """64-bit BLAKE2 hashes under a key."""
    start = hashlib.blake2b(digest_size=8, key=key)

    def one(value: bytes) -> bytes:
        h = start.copy()
        h.update(value)
        return h.digest()

    return np.frombuffer(b"".join(map(one, values)), "<u8")


def byte_runs(x: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The maximal runs of bytes with ``inside`` in each row, one row after another, as binary values; and each row's number of them."""
    new = np.ones(len(x) + 1, bool)  # the byte before is outside or another row's
    new[1:] = np.append(~inside, True)[: len(x)]
    new[offsets] = True
    starts = np.flatnonzero(inside & new[:-1])
    counts = np.diff(np.searchsorted(starts, offsets))
    before = np.cumsum(inside) - inside
    kept = np.ascontiguousarray(x[inside])  # runs side by side
    ends = np.append(before[starts], len(kept)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(kept)]), counts


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string or binary column, one after another, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offsets
    return np.frombuffer(data, np.uint8), offsets


def spans(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs [i, j) of rows with at most ``most`` bytes each, or a single row."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, min(j, n)))
        i = min(j, n)
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    firsts = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - firsts, counts)
