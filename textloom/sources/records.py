"""Question records, key points, preference pairs, chunk files and single-file exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import question_id

RECORD = "query string, text_list array<string>, target_id int"
POINTS = "question string, key_points array<struct<point_number:int,point_content:string,original_point_number:array<int>>>"


def chunk_number(path: Column) -> Column:
    return F.regexp_extract(path, r"datachunk_(\d+)\.json$", 1).cast("int")


def read_chunks(spark: SparkSession, folder: str, record: str = RECORD, gaps: bool = False, last: int = 1000) -> DataFrame:
    """chunk, query_id and the record's columns of ``datachunk_{i}.json`` files, each an object of records by id.

    Without ``gaps`` the chunks count up to the first that is missing; with them, up to number ``last``.
    A file that cannot be parsed has no records.
    """
    files = spark.read.option("pathGlobFilter", "datachunk_*.json").text(folder, wholetext=True).select(chunk_number(F.input_file_name()).alias("chunk"), "value")
    files = files.where(F.col("chunk") <= last) if gaps else files.join(_run(files.select("chunk")), "chunk", "left_semi")
    rows = files.select("chunk", F.explode(F.from_json("value", f"map<string,struct<{_typed(record)}>>")).alias("query_id", "r"))
    return rows.select("chunk", "query_id", "r.*")


def _typed(record: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(record).simpleString()[len("struct<") : -1]


def _run(chunks: DataFrame) -> DataFrame:
    """Chunk numbers from 0 without a gap: the n-th number is n."""
    return chunks.distinct().withColumn("_at", F.row_number().over(Window.orderBy("chunk")) - 1).where("chunk = _at").select("chunk")


def count_records(spark: SparkSession, folder: str) -> int:
    """Records of all chunks, files that cannot be read left out."""
    files = spark.read.option("pathGlobFilter", "datachunk_*.json").option("ignoreCorruptFiles", "true").text(folder, wholetext=True)
    return files.select(F.coalesce(F.size(F.map_keys(F.from_json("value", "map<string,string>"))), F.lit(0)).alias("n")).agg(F.sum(F.greatest("n", F.lit(0)))).first()[0] or 0


def read_key_points(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, question, key_points of ``{id}_aggregated.json`` files."""
    files = spark.read.option("pathGlobFilter", "*_aggregated.json").text(folder, wholetext=True)
    return files.select(question_id(F.input_file_name()).alias("query_id"), F.from_json("value", POINTS).alias("p")).select("query_id", "p.*")


def read_raw_key_points(spark: SparkSession, folder: str) -> DataFrame:
    """query_id, question, source and its points; the key ``null`` is no source."""
    files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).where(F.input_file_name().rlike(r"/\d+\.json$"))
    schema = "question string, key_points map<string,array<struct<point_number:int,point_content:string>>>"
    rows = files.select(question_id(F.input_file_name()).alias("query_id"), F.from_json("value", schema).alias("p"))
    return rows.select("query_id", "p.question", F.explode_outer("p.key_points").alias("source", "points")).withColumn("source", F.nullif("source", F.lit("null")))


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """id, query, good_document, bad_document of one object of records by id."""
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "map<string,struct<query:string,good_document:string,bad_document:string>>")).alias("id", "r"))
    return rows.select("id", "r.*")


def chunked(rows: DataFrame, key: str = "query_id", size: int = 100) -> DataFrame:
    """Adds chunk: runs of ``size`` rows by key."""
    from ..operators.preparation import indexed

    return indexed(rows, [key], "_i").withColumn("chunk", F.floor(F.col("_i") / size)).drop("_i")


def write_chunks(rows: DataFrame, path: str, key: str = "query_id", size: int = 100) -> None:
    """One JSON object of records by key for each chunk of ``size`` rows, in folders ``chunk={i}``."""
    others = [c for c in rows.columns if c != key]
    whole = chunked(rows, key, size).groupBy("chunk").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.struct(*others).alias("v")))))).alias("value"))
    whole.write.mode("ignore").partitionBy("chunk").text(path)


def export_single(rows: DataFrame, key: str | None = None, extra: dict | None = None) -> DataFrame:
    """One row ``value``: an object of records by key, or without a key a list of records. (A file in one piece: for small exports.)"""
    rows = rows.withColumns({k: F.lit(v) for k, v in (extra or {}).items()})
    fields = [c for c in rows.columns if c != key]
    if key:
        return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.struct(*fields).alias("v")))))).alias("value"))
    return rows.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("value"))


def append_results(rows: DataFrame, path: str) -> None:
    """Results are appended by (query_id, method), not written into their records."""
    rows.write.mode("append").parquet(path)


def latest_results(spark: SparkSession, path: str, keys: tuple[str, ...] = ("query_id", "method"), time: str = "written") -> DataFrame:
    """The last result of each key."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(time)).alias("r")).select(*keys, "r.*")


def write_pairs_log(rows: DataFrame, path: str, digits: int = 2) -> None:
    """chosen and rejected rounded, a JSON line each."""
    rows.select(F.round("chosen", digits).alias("chosen"), F.round("rejected", digits).alias("rejected")).write.mode("append").json(path)


def write_predictions(rows: DataFrame, path: str) -> None:
    rows.select("prompt", "predict", "label").write.mode("append").json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path, sep="\t")


def write_results(rows: DataFrame, path: str) -> None:
    """The same rows as ``{path}/tsv`` and as ``{path}/json``."""
    write_tsv(rows, f"{path}/tsv")
    rows.write.mode("overwrite").json(f"{path}/json")


def save_tokenized(rows: DataFrame, path: str) -> None:
    """A tokenised data set as a table; one that is there stays."""
    rows.write.mode("ignore").parquet(path)


def load_tokenized(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved data set, or nothing where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def revision_name(base: str, low: float, high: float) -> str:
    """The configuration's name of a data set filtered by pass rate."""
    return f"{base}-filt-{low:g}-{high:g}"


def write_log(rows: DataFrame, path: str) -> None:
    """JSON lines; null fields are left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def last_log(spark: SparkSession, path: str, step: str = "current_steps") -> DataFrame:
    rows = spark.read.json(path)
    return rows.agg(F.max_by(F.struct("*"), F.col(step)).alias("r")).select("r.*")


def log_tail(spark: SparkSession, path: str, chars: int = 20_000) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.right("value", F.lit(chars)).alias("value"))


def latest_file(spark: SparkSession, folder: str, glob: str = "*") -> str | None:
    """Path of the file changed last."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    found = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return found.p if found else None


def save_checkpoint(rows: DataFrame, path: str, name: str) -> None:
    rows.withColumn("checkpoint", F.lit(name)).write.mode("append").partitionBy("checkpoint").parquet(path)


def load_checkpoint(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("checkpoint") == name).drop("checkpoint")
