"""Data sets by description: files by type, a registry of readers, choice questions, test cases."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File types by ending.
FILE_TYPES = {"arrow": "arrow", "csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "txt": "text"}
READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    def add(f):
        if name in READERS:
            raise ValueError(f"reader {name} exists")
        READERS[name] = f
        return f

    return add


@dataclass(frozen=True)
class Dataset:
    """A data set: where it is, its layout, and the names of its columns and roles."""

    name: str
    source: str = "file"
    location: str = ""
    formatting: str = "alpaca"
    ranking: bool = False
    subset: str | None = None
    split: str = "train"
    folder: str | None = None
    num_samples: int | None = None
    columns: dict[str, str] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)


def load_registry(text: str, names: list[str]) -> list[Dataset]:
    """Descriptions of ``names`` from a JSON registry; of several sources a hub comes before a script, a cloud file, a file."""
    known, out = json.loads(text), []
    for n in names:
        if n not in known:
            raise ValueError(f"undefined data set {n}")
        d = known[n]
        source = next((s for k, s in (("hf_hub_url", "hf_hub"), ("ms_hub_url", "ms_hub"), ("om_hub_url", "om_hub"), ("script_url", "script"), ("cloud_file_name", "cloud_file"), ("file_name", "file")) if k in d), None)
        if source is None:
            raise ValueError(f"data set {n} has no source")
        key = {"cloud_file": "cloud_file_name", "file": "file_name"}.get(source, f"{source}_url")
        out.append(Dataset(n, source, d[key], d.get("formatting", "alpaca"), d.get("ranking", False), d.get("subset"), d.get("split", "train"), d.get("folder"), d.get("num_samples"), d.get("columns", {}), d.get("tags", {})))
    return out


def file_type(paths: list[str]) -> str:
    """The one type of all files."""
    kinds = {FILE_TYPES.get(p.rsplit(".", 1)[-1].lower()) for p in paths}
    if None in kinds or len(kinds) != 1:
        raise ValueError(f"files must be of one known type: {sorted(map(str, paths))}")
    return kinds.pop()


@reader("file")
def read_files(spark: SparkSession, location: str, schema: str | None = None) -> DataFrame:
    """A file or a folder of files of one type. A ``.json`` file may be one array; ``.arrow`` files are read in tasks."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location).select("path")
    kind = file_type([r.path for r in listed.collect()])  # names of files only
    one = lambda r: r.schema(schema) if schema else r
    if kind == "csv":
        return one(spark.read.option("header", "true")).csv(location)
    if kind == "json":
        lines = listed.where(~F.lower("path").endswith(".jsonl")).isEmpty()
        return one(spark.read.option("multiLine", str(not lines).lower())).json(location)
    if kind == "arrow":
        return read_arrow(spark, location, schema)
    return one(spark.read.format(kind)).load(location)


def read_arrow(spark: SparkSession, location: str, schema: str | None = None) -> DataFrame:
    """Arrow IPC files or streams."""
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(location).select("content")

    def batches(data: bytes):
        try:
            r = pa.ipc.open_file(data)
            return [r.get_batch(i) for i in range(r.num_record_batches)]
        except pa.ArrowInvalid:
            return list(pa.ipc.open_stream(data))

    def run(it):
        for b in it:
            for x in b["content"]:
                yield from batches(x.as_py())

    if schema is None:
        from pyspark.sql.pandas.types import from_arrow_schema

        schema = from_arrow_schema(batches(files.first().content)[0].schema)
    return files.mapInArrow(run, schema)


@reader("cloud_file")
def read_cloud(spark: SparkSession, location: str, schema: str | None = None) -> DataFrame:
    """JSON or JSON lines in an object store that Spark has a file system for: without credentials first, then with the cluster's own."""
    if not location.startswith(("s3://", "s3a://", "gs://", "gcs://")):
        raise ValueError(f"not a cloud location: {location}")
    path = location.replace("s3://", "s3a://", 1).replace("gcs://", "gs://", 1)
    anonymous = {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider", "fs.gs.auth.type": "UNAUTHENTICATED"}
    for options in (anonymous, {}):
        r = spark.read.options(**options).option("multiLine", str(path.endswith(".json")).lower())
        try:
            return (r.schema(schema) if schema else r).json(path)
        except Exception:  # whatever the store's client says of credentials
            if not options:
                raise
    raise AssertionError


def read_dataset(spark: SparkSession, d: Dataset, **options) -> DataFrame:
    """Rows by the reader of the source; hubs and scripts need one registered."""
    if d.source not in READERS:
        raise ValueError(f"no reader for {d.source}; register one")
    return READERS[d.source](spark, d.location, **options)


def read_training_json(spark: SparkSession, path: str) -> DataFrame:
    """problem, solution and answer (the solution again)."""
    rows = spark.read.schema("problem string, solution string").option("multiLine", "true").json(path)
    return rows.withColumn("answer", F.col("solution"))


def read_choices(spark: SparkSession, path: str, split: str, header: bool = True) -> DataFrame:
    """question, A to D, answer and split of comma-separated files with or without a header."""
    schema = ("id int, " if header else "") + "question string, A string, B string, C string, D string, answer string" + (", explanation string" if header else "")
    return spark.read.option("header", str(header).lower()).option("escape", '"').option("multiLine", "true").csv(path, schema=schema).withColumn("split", F.lit(split))


def test_cases(rows: DataFrame, key: str = "problem_id", name: str | None = None) -> DataFrame:
    """Cases of each problem: an array of {input, output}, or a map of these by the test's name."""
    case = F.struct("input", "output")
    if name:
        return rows.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), case.alias("v"))))).alias("cases"))
    return rows.groupBy(key).agg(F.collect_list(case).alias("cases"))


def with_generated(problems: DataFrame, generated: DataFrame, key: str = "problem_id") -> DataFrame:
    """Official cases and, where there are some, generated ones after them."""
    other = generated.select(key, F.col("cases").alias("_more"))
    return problems.join(other, key, "left").withColumn("cases", F.concat("cases", F.coalesce("_more", F.array_except("cases", "cases")))).drop("_more")
