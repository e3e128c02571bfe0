"""Downloads from a server on this machine: rate limits, errors, files that are there, data sets of several configurations."""

import base64
import io
import json
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textloom.sources.datasets import Dataset, read_dataset
from textloom.sources.records import read_key_points
from textloom.sources.web import Patience, download_folder, fetched, get, read_hub, reconstruct

QUICK = Patience(retries=2, limit_wait=0.05, error_wait=0.02)


def parquet(rows):
    out = io.BytesIO()
    pq.write_table(pa.Table.from_pylist(rows), out)
    return out.getvalue()


@pytest.fixture(scope="module")
def server():
    asked: Counter = Counter()
    point = {"question": "q", "key_points": [{"point_number": 1, "point_content": "c", "original_point_number": [1]}]}
    wrapped = lambda data: json.dumps({"content": base64.b64encode(data).decode()}).encode()
    rows = [{"query_id": f"q{i}", "query": f"text {i}", "target_id": i} for i in range(230)]

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args):
            pass

        def do_GET(self):
            asked[self.path] += 1
            n, top = asked[self.path], f"http://127.0.0.1:{self.server.server_port}"
            code, body, headers = 200, b"", {}
            if self.path == "/contents":
                body = json.dumps([{"type": "dir", "name": "x.json", "url": ""}, {"type": "file", "name": "readme.md", "url": ""}] + [{"type": "file", "name": f"{k}_aggregated.json", "url": f"{top}/file/{k}"} for k in ("a", "limited", "broken", "gone", "have", "bare")]).encode()
            elif self.path == "/file/limited" and n == 1:
                code, headers = 403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": str(int(time.time()) - 10)}
            elif self.path == "/file/broken" and n < 3:
                code = 503
            elif self.path == "/file/gone":
                code = 404
            elif self.path == "/file/bare":
                body = b"{}"
            elif self.path.startswith("/file/"):
                body = wrapped(json.dumps(point).encode())
            elif self.path == "/denied":
                code, headers = 403, {"X-RateLimit-Remaining": "7"}
            elif self.path == "/token":
                body = (self.headers.get("Authorization") or "").encode()
            elif self.path == "/api/datasets/me/set/parquet":
                one = {"train": [f"{top}/p/0"]}
                body = json.dumps({"main": {"train": [f"{top}/p/0", f"{top}/p/1"], "test": [f"{top}/p/0"]}, "rule_candidate": one, "inference": one, "other": one, "grpo_eval": {"train": [f"{top}/p/none"]}}).encode()
            elif self.path == "/p/none":
                code = 404
            elif self.path.startswith("/p/"):
                body = parquet(rows[:130] if self.path[-1] == "0" else rows[130:])
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body)

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


def test_folder(spark, server, tmp_path):
    top, asked = server
    (tmp_path / "have_aggregated.json").write_text(json.dumps({"question": "mine", "key_points": []}))
    done = {r.name: r for r in download_folder(spark, f"{top}/contents", f"file://{tmp_path}", patience=QUICK).collect()}
    assert {n for n, r in done.items() if r.error is None} == {"a_aggregated.json", "limited_aggregated.json", "broken_aggregated.json"}
    assert "404" in done["gone_aggregated.json"].error and "KeyError" in done["bare_aggregated.json"].error
    assert asked["/file/have"] == 0 and asked["/file/limited"] == 2 and asked["/file/broken"] == 3
    points = {r.query_id: r.question for r in read_key_points(spark, str(tmp_path)).collect()}
    assert points == {"a": "q", "limited": "q", "broken": "q", "have": "mine"}
    before = sum(asked.values())
    again = download_folder(spark, f"{top}/contents", f"file://{tmp_path}", patience=QUICK).collect()
    assert {r.name for r in again} == {"gone_aggregated.json", "bare_aggregated.json"} and sum(asked.values()) == before + 3


def test_a_partition_for_each_file(spark, server):
    top, _ = server
    rows = fetched(spark, [(f"n{i}", f"{top}/p/{i}") for i in range(2)], patience=QUICK)
    assert rows.rdd.getNumPartitions() == 2 and rows.where("error IS NULL").count() == 2
    assert fetched(spark, []).count() == 0


def test_waits_and_refusals(server):
    top, asked = server
    waits = []
    with pytest.raises(OSError):
        get(f"{top}/denied", None, QUICK, waits.append)
    assert not waits and asked["/denied"] == 1
    with pytest.raises(OSError):
        get("http://127.0.0.1:9/", None, QUICK, waits.append)
    assert waits == [0.02, 0.04]
    assert get(f"{top}/token", "secret", QUICK) == b"Bearer secret" and get(f"{top}/token", None, QUICK) == b""


def test_hub(spark, server, tmp_path):
    top, _ = server
    assert read_hub(spark, "me/set", "main", endpoint=top, patience=QUICK).count() == 230
    assert read_dataset(spark, Dataset("x", "hf_hub", "me/set"), endpoint=top, patience=QUICK).count() == 230
    with pytest.raises(ValueError):
        read_hub(spark, "me/set", "rule_candidate", "test", endpoint=top, patience=QUICK)
    targets = {k: f"file://{tmp_path}/{k}" for k in ("main/train", "main/test", "rule_candidate", "inference", "grpo_eval")}
    said = reconstruct(spark, "me/set", targets, top, patience=QUICK)
    assert {k: v.split(":")[0] for k, v in said.items()} == {"main/train": "done", "main/test": "done", "rule_candidate/train": "done", "inference/train": "done", "other/train": "no target", "grpo_eval/train": "failed"}
    chunks = sorted((tmp_path / "main/train").glob("chunk=*"))
    records = [json.loads(p.read_text()) for c in chunks for p in c.glob("*.txt")]
    assert len(chunks) == 3 and sum(map(len, records)) == 230 and records[0]["q0"]["query"] == "text 0"
    by_id = json.loads(next((tmp_path / "rule_candidate").glob("*.txt")).read_text())
    listed = json.loads(next((tmp_path / "inference").glob("*.txt")).read_text())
    assert len(by_id) == 130 and listed[0]["output"] == "" and {r["query_id"] for r in listed} == set(by_id)
    assert set(reconstruct(spark, "me/set", targets, top, patience=QUICK).values()) - {"no target"} <= {"exists"} | {v for v in said.values() if v.startswith("failed")}
