"""Files of records written and read again; streams resumed."""

import json

import pytest

from textloom.sources import datasets, records
from textloom.streaming import incremental


def test_chunks(spark, tmp_path):
    rec = lambda i: {f"q{i:03}": {"query": f"what {i}", "text_list": ["a", "b"], "target_id": i % 2}}
    for k in (0, 1, 3):
        (tmp_path / f"datachunk_{k}.json").write_text(json.dumps(rec(2 * k) | rec(2 * k + 1)))
    (tmp_path / "datachunk_1001.json").write_text(json.dumps(rec(999)))
    assert sorted((r.chunk, r.query_id) for r in records.read_chunks(spark, str(tmp_path)).collect()) == [(0, "q000"), (0, "q001"), (1, "q002"), (1, "q003")]
    assert records.read_chunks(spark, str(tmp_path), gaps=True).count() == 6
    (tmp_path / "datachunk_4.json").write_text("{broken")
    assert records.count_records(spark, str(tmp_path)) == 7
    rows = records.read_chunks(spark, str(tmp_path), gaps=True).drop("chunk")
    records.write_chunks(rows, str(tmp_path / "out"), size=4)
    whole = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(map(len, whole)) == [2, 4] and whole[0].keys().isdisjoint(whole[1])
    single = json.loads(records.export_single(rows, "query_id", {"by": "x"}).first().value)
    assert single["q000"] == {"query": "what 0", "text_list": ["a", "b"], "target_id": 0, "by": "x"}
    assert len(json.loads(records.export_single(rows).first().value)) == 6


def test_key_points(spark, tmp_path):
    (tmp_path / "7_aggregated.json").write_text(json.dumps({"question": "q", "key_points": [{"point_number": 1, "point_content": "c", "original_point_number": [1, 2]}]}))
    (tmp_path / "8_aggregated.json").write_text(json.dumps({"question": "q", "key_points": []}))
    (tmp_path / "9.json").write_text(json.dumps({"question": "q", "key_points": {"null": [{"point_number": 1, "point_content": "c"}]}}))
    got = {r.query_id: r for r in records.read_key_points(spark, str(tmp_path)).collect()}
    assert got["7"].key_points[0].original_point_number == [1, 2] and got["8"].key_points == []
    from textloom.operators.utility import with_key_points

    q = spark.createDataFrame([("7",), ("8",), ("1",)], "query_id string")
    assert {r.query_id: bool(r.key_points) for r in with_key_points(q, records.read_key_points(spark, str(tmp_path))).collect()} == {"7": True, "8": False, "1": False}
    assert records.read_raw_key_points(spark, str(tmp_path)).first().source is None


def test_files(spark, tmp_path):
    import pyarrow as pa

    table = pa.table({"a": [1, 2], "b": ["x", None]})
    with pa.ipc.new_file(str(tmp_path / "t.arrow"), table.schema) as w:
        w.write_table(table)
    assert [tuple(r) for r in datasets.read_files(spark, str(tmp_path / "t.arrow")).collect()] == [(1, "x"), (2, None)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert datasets.read_files(spark, str(tmp_path / "j")).count() == 2
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2}, {"a": 3}]')
    assert datasets.read_files(spark, str(tmp_path / "a.json")).count() == 3
    (tmp_path / "j/b.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        datasets.read_files(spark, str(tmp_path / "j"))
    with pytest.raises(ValueError):
        datasets.read_cloud(spark, "http://x/y.json")
    found = datasets.load_registry(json.dumps({"d": {"file_name": "a.json", "hf_hub_url": "x/y", "columns": {"prompt": "q"}}}), ["d"])[0]
    assert (found.source, found.location, found.columns) == ("hf_hub", "x/y", {"prompt": "q"})
    with pytest.raises(ValueError):
        datasets.load_registry("{}", ["d"])


def test_stream_resumes(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.range(10).write.parquet(source)
    run = lambda: incremental.run(incremental.read_stream(spark, source, "id long"), incremental.append_to(out, incremental.shuffled("id")), check)
    run()
    spark.range(10, 15).write.mode("append").parquet(source)
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(15))
