"""Folders of repositories and data sets of hubs, downloaded in tasks: a Python data source with a partition for each file.

The driver lists names and addresses; each file is fetched by a task, which waits when the server says that the rate limit
is reached, and tries again. What is in the target folder already is not fetched. A file that cannot be had is a row with
an error, not the end of the job.
"""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shared import remember, shared_dir, table
from ..ship import ship
from .datasets import reader
from .records import export_single, write_chunks

FORMAT = "web_files"


@dataclass(frozen=True)
class Patience:
    """How often to try again, the least wait for a rate limit, and the wait after a server's error, which doubles."""

    retries: int = 5
    limit_wait: float = 60.0
    error_wait: float = 1.0


def get(url: str, token: str | None, patience: Patience, sleep=time.sleep) -> bytes:
    """The body of an address. 403 and 429 with no requests left wait for the reset that the answer names; 5xx and lost connections wait a while; others are errors."""
    request = urllib.request.Request(url, headers={"User-Agent": "textloom"} | ({"Authorization": f"Bearer {token}"} if token else {}))
    for attempt in range(patience.retries + 1):
        try:
            with urllib.request.urlopen(request, timeout=120) as answer:
                return answer.read()
        except urllib.error.HTTPError as e:
            limited = e.code in (403, 429) and e.headers.get("X-RateLimit-Remaining", "0") == "0"
            if attempt == patience.retries or not limited and e.code < 500:
                raise
            wait = patience.error_wait * 2**attempt
            if limited:
                after = e.headers.get("Retry-After", "")
                reset = float(after) if after.isdigit() else float(e.headers.get("X-RateLimit-Reset", 0)) - time.time() + 5
                wait = max(patience.limit_wait, reset)
        except (urllib.error.URLError, ConnectionError, TimeoutError):
            if attempt == patience.retries:
                raise
            wait = patience.error_wait * 2**attempt
        sleep(wait)
    raise AssertionError


@dataclass
class WebFile(InputPartition):
    name: str
    url: str


class WebReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = [WebFile(*f) for f in json.loads(options["files"])]
        self.token = options.get("token") or None
        self.wrapped = options.get("wrapped", "false") == "true"
        self.patience = Patience(int(options.get("retries", 5)), float(options.get("limit_wait", 60)), float(options.get("error_wait", 1)))

    def partitions(self) -> list[InputPartition]:
        return self.files or [WebFile("", "")]

    def read(self, partition: WebFile) -> Iterator[tuple]:
        if not partition.url:
            return
        try:
            body = get(partition.url, self.token, self.patience)
            if self.wrapped:  # a JSON object with the content in base 64
                body = base64.b64decode(json.loads(body)["content"])
            yield partition.name, body, None
        except (OSError, ValueError, KeyError) as e:
            yield partition.name, None, f"{type(e).__name__}: {e}"


class WebFiles(DataSource):
    """(name, content, error) of files at addresses: option ``files`` is a JSON list of [name, address]."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, content binary, error string"

    def reader(self, schema) -> WebReader:
        return WebReader(self.options)


def fetched(spark: SparkSession, files: list[tuple[str, str]], token: str | None = None, patience: Patience = Patience(), wrapped: bool = False) -> DataFrame:
    """(name, content, error) of ``files`` (name, address), each by a task of its own; null content where it could not be had."""
    ship(spark)
    spark.dataSource.register(WebFiles)
    options = {"files": json.dumps(files), "token": token or "", "wrapped": str(wrapped).lower(), "retries": patience.retries, "limit_wait": patience.limit_wait, "error_wait": patience.error_wait}
    return spark.read.format(FORMAT).options(**options).load()


def names_in(spark: SparkSession, folder: str) -> set[str]:
    """Names of the files in a folder; none where there is no folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()


def saved(rows: DataFrame, folder: str) -> DataFrame:
    """Writes ``rows`` (name, content, error) as files of a folder that all executors reach; (name, bytes, error) of each. A file is seen under its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(folder)
        files.create_dir(top, recursive=True)
        for b in batches:
            sizes = []
            for name, content in zip(b["name"].to_pylist(), b["content"], strict=True):
                data = content.as_buffer() if content.is_valid else None
                if data is not None:
                    part = f"{top}/_{uuid.uuid4().hex}"
                    with files.open_output_stream(part) as out:
                        out.write(data)
                    files.move(part, f"{top}/{name}")
                sizes.append(None if data is None else len(data))
            yield pa.RecordBatch.from_arrays([b["name"], pa.array(sizes, pa.int64()), b["error"]], ["name", "bytes", "error"])

    return table(rows.mapInArrow(run, "name string, bytes long, error string"), "downloads")


def download_folder(spark: SparkSession, listing: str, folder: str, token: str | None = None, patience: Patience = Patience(), ending: str = ".json") -> DataFrame:
    """(name, bytes, error) of the files that were fetched of a repository's folder.

    ``listing``: the address of its contents, a JSON list of {type, name, url}, where each file's address gives its content in base 64.
    Files in ``folder`` already are left as they are. The token is also taken from GITHUB_TOKEN.
    """
    token = token or os.environ.get("GITHUB_TOKEN")
    found = [(x["name"], x["url"]) for x in json.loads(get(listing, token, patience)) if x["type"] == "file" and x["name"].endswith(ending)]
    have = names_in(spark, folder)
    return saved(fetched(spark, [f for f in found if f[0] not in have], token, patience, wrapped=True), folder)


def hub_files(endpoint: str, repo: str, token: str | None = None, patience: Patience = Patience()) -> dict[str, dict[str, list[str]]]:
    """Addresses of the Parquet files of a data set by configuration and split, as a hub's interface lists them."""
    return json.loads(get(f"{endpoint}/api/datasets/{repo}/parquet", token, patience))


def _hub_rows(spark: SparkSession, addresses: list[str], token: str | None, patience: Patience) -> DataFrame:
    folder = f"{shared_dir(spark)}/hub-{uuid.uuid4().hex}"
    remember(spark, folder)
    done = saved(fetched(spark, [(f"{i:05d}.parquet", a) for i, a in enumerate(addresses)], token, patience), folder)
    failed = done.where("error IS NOT NULL").first()
    if failed:
        raise OSError(f"{failed.name}: {failed.error}")
    return spark.read.parquet(folder)


@reader("hf_hub")
def read_hub(spark: SparkSession, location: str, subset: str | None = None, split: str = "train", endpoint: str = "https://huggingface.co", token: str | None = None, patience: Patience = Patience()) -> DataFrame:
    """A split of a data set of a hub; without ``subset`` the first configuration. A split without files is an error."""
    listed = hub_files(endpoint, location, token, patience)
    splits = listed[subset] if subset else next(iter(listed.values()), {})
    if not splits.get(split):
        raise ValueError(f"{location} has no split {split} in {subset or 'its first configuration'}")
    return _hub_rows(spark, splits[split], token, patience)


# Configurations of the questions' data set, and the file or folder that each is kept in.
LAYOUT = {"rule_candidate": ("by_id", {}), "grpo_eval": ("by_id", {}), "cold_start": ("list", {}), "grpo_input": ("list", {}), "inference": ("list", {"output": ""})}


def reconstruct(spark: SparkSession, repo: str, targets: dict[str, str], endpoint: str = "https://huggingface.co", token: str | None = None, patience: Patience = Patience(), key: str = "query_id") -> dict[str, str]:
    """Downloads each configuration of a data set into the layout the other readers expect; says of each split what became of it.

    ``targets``: folder by name: ``main/train`` and ``main/test`` get chunk files, the configurations of ``LAYOUT`` one file. A folder that
    has files is left as it is; a configuration without a target is passed over; one that fails does not end the others.
    """
    out = {}
    for config, splits in hub_files(endpoint, repo, token, patience).items():
        for name, addresses in splits.items():
            target = f"{config}/{name}" if config == "main" else config
            if target not in targets or config != "main" and (config not in LAYOUT or name != "train"):
                out[f"{config}/{name}"] = "no target"
                continue
            if any(not n.startswith(("_", ".")) for n in names_in(spark, targets[target])):
                out[f"{config}/{name}"] = "exists"
                continue
            try:
                rows = _hub_rows(spark, addresses, token, patience)
                if config == "main":
                    write_chunks(rows, targets[target], key)
                else:
                    layout, extra = LAYOUT[config]
                    whole = export_single(rows, key if layout == "by_id" else None, extra)
                    whole.coalesce(1).write.mode("overwrite").text(targets[target])
                out[f"{config}/{name}"] = "done"
            except (OSError, ValueError) as e:
                out[f"{config}/{name}"] = f"failed: {e}"
    return out
