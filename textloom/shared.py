"""Tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of our own on a local master; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("spark.textloom.shared.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.textloom.shared.dir", found)
        _made.append((spark, found))
    return found.rstrip("/")


def table(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back: lineage is cut and survives lost executors.

    Shuffle files of the write go as soon as it is done. The table stays until :func:`drop_table`, :func:`drop_all` or
    the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._textloom_path = path
    return out


def remember(spark: SparkSession, path: str) -> None:
    """A folder of our own to delete with the tables, by :func:`drop_all` or at the end of the process."""
    _made.append((spark, path))


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`table` once nothing reads it any more."""
    _delete(df.sparkSession, df._textloom_path)


def drop_all(spark: SparkSession) -> None:
    """Delete all tables made in ``spark``: for long sessions, when no result is still to be read."""
    for entry in [e for e in _made if e[0] is spark]:
        _delete(*entry)
        _made.remove(entry)
    spark.conf.unset("spark.textloom.shared.dir")


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, with underscores before those that ``columns`` have, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # the session has ended
            pass
