"""Whitening of vectors by the eigenvectors of a covariance that is computed in tiles.

The d dimensions are cut into column blocks; a pair of blocks is a tile. Rows are cut into row blocks. Each column block
of a row block is sent to every tile that needs it, keyed by row block and tile, so that the two sides of a tile meet;
there they are centred and multiplied, products of one task are added up for each tile, and the tiles' sums over all
tasks are assembled into the covariance, whose eigenvectors are found on the driver (d x d numbers, however many rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ship
from .common import table

SCALE, SHIFT = 64, 1_000_000
_BLOCK = "chunk long, i int, j int, side int, n int, kind string, data binary"


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), d)


def _sums(d: int):
    """Exact sums of each dimension, one row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch["x"], d)
            wide = len(x) and max(abs(int(x.max())), abs(int(x.min()))) * len(x) >= 1 << 62
            sums = x.astype(object).sum(0) if wide else x.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([[str(int(s)) for s in sums]], pa.list_(pa.string()))], ["n", "sums"])

    return run


def _smallest(x: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if len(x) == 0 or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def _column_blocks(d: int, width: int, rows: int):
    """Row blocks -> their column blocks, each for every tile that it is a side of."""
    blocks = -(-d // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                some = batch.slice(at, rows)
                x = _matrix(some["x"], d) - SHIFT
                chunk = some["at"][0].as_py()
                out = []
                for b in range(blocks):
                    part = _smallest(np.ascontiguousarray(x[:, b * width : (b + 1) * width]))
                    for other in range(blocks):
                        i, j = min(b, other), max(b, other)
                        out.append((chunk, i, j, int(b != i), len(x), part.dtype.str, part.tobytes()))
                names = ["chunk", "i", "j", "side", "n", "kind", "data"]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _multiply(means: np.ndarray, width: int):
    """Column blocks sorted by tile, row block and side -> the sum of the task's products for each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, total, left = None, None, None

        def row(tile, total):
            return pa.RecordBatch.from_arrays([pa.array([tile[0]], pa.int32()), pa.array([tile[1]], pa.int32()), pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["i", "j", "v"])

        for batch in batches:
            for r in batch.to_pylist():
                mean = means[(r["j"] if r["side"] else r["i"]) * width :][:width]
                x = np.frombuffer(r["data"], r["kind"]).reshape(r["n"], -1) - mean  # centred before multiplying
                if (r["i"], r["j"]) != tile:
                    if tile is not None:
                        yield row(tile, total)
                    tile, total = (r["i"], r["j"]), 0
                if r["i"] == r["j"]:
                    total = total + x.T @ x
                elif not r["side"]:
                    left = x
                else:
                    total = total + left.T @ x
        if tile is not None:
            yield row(tile, total)

    return run


def _tiles(blocks: DataFrame, means: np.ndarray, width: int) -> np.ndarray:
    """The sums of all tiles, assembled."""
    d = len(means)
    dealt = blocks.repartition("chunk", "i", "j").sortWithinPartitions("i", "j", "chunk", "side")
    sums = dealt.mapInArrow(_multiply(means, width), "i int, j int, v array<double>").select("i", "j", F.posexplode("v").alias("k", "v"))
    out = np.zeros((d, d))
    for i, j, k, v in sums.groupBy("i", "j", "k").agg(F.sum("v")).collect():  # d * d numbers
        r, c = divmod(k, min(width, d - j * width))
        out[i * width + r, j * width + c] = out[j * width + c, i * width + r] = v
    return out


def _whiten(x: np.ndarray, means: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return ((x - SHIFT) - means) @ axes


def _moments(d: int, means: np.ndarray, axes: np.ndarray, centre: np.ndarray | None):
    """Sums of the whitened values or, with their mean, of the products of the centred ones; one row for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            w = _whiten(_matrix(batch["x"], d), means, axes)
            total = total + (w.sum(0) if centre is None else (w - centre).T @ (w - centre))
        if not isinstance(total, int):
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["v"])

    return run


def _result(d: int, n: int, sums: list[int], means: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float):
    k = axes.shape[1]
    shifted = [s - n * SHIFT for s in sums]

    def deviation(x: np.ndarray) -> list[int | None]:
        x = x - SHIFT
        low, high = int(x.min()), int(x.max())
        far = max(abs(n * v - s) for v in (low, high) for s in (min(shifted), max(shifted)))
        if far * far * d < 1 << 63:
            return ((x * n - np.array(shifted, np.int64)) ** 2).sum(1).tolist()
        whole = ((x.astype(object) * n - np.array(shifted, object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in whole]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                some = batch.slice(at, 2048)
                x = _matrix(some["x"], d)
                rows = np.repeat(np.arange(len(x)), k)
                cols = {
                    "vec_id": some["vec_id"].take(pa.array(rows)),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    "n": pa.array(np.full(len(rows), n, np.int64)),
                    "deviation": pa.array(deviation(x), pa.int64()).take(pa.array(rows)),
                    "whitened": pa.array(_whiten(x, means, axes).ravel()),
                    "explained": pa.array(np.tile(explained, len(x))),
                    "identity_error": pa.array(np.full(len(rows), error)),
                }
                yield pa.RecordBatch.from_pydict(cols)

    return run


def covariance(fit: DataFrame, d: int, n: int, sums: list[int], width: int = 32, rows: int = 4096) -> np.ndarray:
    """Covariance (divisor n) of the integer vectors ``x`` of ``fit`` (at, x), in tiles of ``width`` dimensions."""
    means = np.array([float(Decimal(s - n * SHIFT) / n) for s in sums])
    return _tiles(fit.mapInArrow(_column_blocks(d, width, rows), _BLOCK), means, width) / n


def whitened(vectors: DataFrame, key: str, column: str, most: int = 32, width: int = 32, rows: int = 4096) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each vector and each of the first ``most`` components.

    Dropped: null vectors, vectors with null or non-finite entries, and those whose length is not the most frequent one
    (of equally frequent lengths the largest stays). Entries c become floor(64 c) + 1000000. Components whose variance is 0
    to double precision have no whitened value and are left out, so that a table of equal vectors, of one vector or of none
    gives no rows. Repeated rows count each; keys may be null or repeat; other columns are not read. A deviation that no
    long holds is null.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(f"`{column}`").cast("array<double>")
    rows_ = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v"))
    rows_ = rows_.where(F.coalesce(F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), F.lit(False)))
    lengths = rows_.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if lengths is None or not lengths.d:
        return empty
    d = lengths.d
    whole = rows_.where(F.size("v") == d).select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"), F.monotonically_increasing_id().alias("at"))
    fit = table(whole, "vectors")
    parts = fit.select("x").mapInArrow(_sums(d), "n long, sums array<string>")
    summed = parts.select("n", F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("k").collect()
    n, sums = summed[0].n, [int(r.s) for r in summed]
    V = covariance(fit, d, n, sums, width, rows)
    e, axes = np.linalg.eigh(V)
    e, axes = e[::-1], axes[:, ::-1]
    real = e > max(e[0], 0) * d * np.finfo(float).eps
    k = int(min(most, real.sum()))
    if not k or e[0] <= 0:
        return empty
    means = np.array([float(Decimal(s - n * SHIFT) / n) for s in sums])
    axes = axes[:, :k] / np.sqrt(e[:k])
    total = lambda centre: np.array([r[1] for r in fit.select("x").mapInArrow(_moments(d, means, axes, centre), "v array<double>").select(F.posexplode("v").alias("k", "v")).groupBy("k").agg(F.sum("v")).orderBy("k").collect()]) / n
    error = float(np.abs(total(total(None)).reshape(k, k) - np.eye(k)).max())
    explained = e[:k] / np.trace(V)
    return fit.select("vec_id", "x").mapInArrow(_result(d, n, sums, means, axes, explained, error), empty.schema)
