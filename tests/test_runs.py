"""Programs under limits, generation runs that go on, dummy media."""

import pytest
from pyspark.sql import functions as F

from textloom.operators.generation import distilled, generation_run, in_batches
from textloom.operators.packing import IGNORE, with_dummy_media
from textloom.operators.runner import CASES, Limits, judge, run_program, with_judgment
from textloom.operators.scorer import executed

LIMITS = Limits(seconds=3.0, memory_mb=256, output_bytes=4096, processes=3)
PROGRAMS = {
    "AC": "a, b = map(int, input().split())\nprint(a + b)  ",
    "WA": "a, b = map(int, input().split())\nprint(a - b)",
    "RE": "raise SystemExit(3)",
    "TLE": "while True:\n    pass",
    "MLE": "x = bytearray(10**9)",
    "OLE": "while True:\n    print('x' * 1000)",
}


@pytest.mark.parametrize("verdict", PROGRAMS)
def test_verdicts(verdict):
    cases = [("1 2", "3\n"), ("5 7", "12")]
    assert judge(PROGRAMS[verdict], "python", cases, LIMITS, batch=1) == ((1.0, "AC", 2) if verdict == "AC" else (0.0, verdict, 1))


def test_children_are_killed_and_batches_end():
    spawn = "import subprocess, sys\nsubprocess.Popen([sys.executable, '-c', 'import time; time.sleep(600)'])\nprint(1)"
    assert run_program(spawn, "python", limits=LIMITS).status == "OK"
    late = "import time\nn = int(input())\nprint(n if n < 3 else 0)"
    cases = [(str(i), str(i)) for i in range(8)]
    assert judge(late, "python", cases, LIMITS, batch=2) == (3 / 8, "WA", 4) and judge(late, "python", cases, LIMITS, batch=2, to_end=True) == (3 / 8, "WA", 8)
    assert run_program("read x; echo $((x * 2)); echo $0", "sh", "21", LIMITS).output.split()[0] == "42"
    assert run_program("import sys\nprint(__name__, len(sys.argv), 'resource' in globals())", "python", limits=LIMITS).output == "__main__ 1 False\n"
    assert judge(None, "python", cases) == (0.0, "CE", 0) and judge("print(1)", "python", []) == (0.0, "CE", 0) and judge("x", "cobol", cases, LIMITS)[1] == "RE"


def test_programs_of_a_table(spark):
    rows = [(k, f"text\n```python\n{p}\n```", "python", [("1 2", "3"), ("2 2", "4")], "clash") for k, p in PROGRAMS.items()] + [("CE", "no program", "python", [("1", "1")], "clash")]
    df = spark.createDataFrame(rows, "verdict string, answer string, language string, cases array<struct<input:string,output:string>>, score string")
    assert df.schema["cases"].dataType == CASES
    from textloom.functions.text import extract_code

    df = df.withColumn("code", extract_code(F.col("answer"), "python"))
    got = {r.verdict: r.judged for r in with_judgment(df, "code", "language", "cases", limits=LIMITS).collect()}
    assert {k: v.verdict for k, v in got.items()} == {k: k for k in got} and got["AC"].score == 1.0 and got["WA"].score == 0.0
    scripts = spark.createDataFrame([("print(0.25)", "python"), ("print('x')", "python"), ("1/0", "python")], "code string, language string")
    assert [r.score for r in executed(scripts, "local").collect()] == [0.25, 0.0, 0.0]


def test_generation_goes_on(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def load(bad):
        def make():
            def generate(prompts):
                with open(calls, "a") as f:
                    f.write("".join(f"{p}\n" for p in prompts))
                if any(b in p for p in prompts for b in bad):
                    raise RuntimeError("no")
                assert max(map(len, prompts)) <= min(map(len, prompts)) + 3  # of like length
                return [p.upper() for p in prompts]

            return generate

        return make

    rows = spark.createDataFrame([(i, "p" * (i % 40 // 10 * 10) + f"<{i}>") for i in range(40)] + [(3, "zzz"), (None, "x"), (77, None)], "id long, text string")
    run = lambda bad, **k: generation_run(rows, "id", F.col("text"), load(bad), f"file://{tmp_path}/store", samples=3, batch=4, wave=50, tasks=3, wait=0.0, **k)
    first = run(["<13>", "<27>"])
    got = distilled(first).collect()
    assert len(got) == 40 and sum(r.errors for r in got) == 6 and {r.key for r in got if r.errors} == {"13", "27"}
    assert next(r for r in got if r.key == "3").generations == ["<3>"] * 3
    asked = open(calls).read().count("\n")
    assert distilled(run([])).where("errors > 0").count() == 2 and open(calls).read().count("\n") == asked  # nothing is left to do
    done = distilled(run([], again=True)).collect()
    assert sum(r.errors for r in done) == 0 and len(done) == 40 and asked + 6 <= open(calls).read().count("\n") <= asked + 12  # a batch of unlike prompts is refused once


def test_prompts_move_once(spark, tmp_path):
    """Of the prompts, a run shuffles what its waves deal out; a run with nothing left to do, and reading the store, shuffle keys only."""
    import random

    sc, draw = spark.sparkContext._jsc.sc(), random.Random(7)
    spark.createDataFrame([(i, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000))) for i in range(100)], "id long, text string").repartition(4).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    run = lambda **k: generation_run(rows, "id", F.col("text"), lambda: lambda prompts: [p[:9] for p in prompts], f"file://{tmp_path}/store", tasks=2, wave=60, **k)

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}

    def shuffled(work):
        before = stages()
        work()
        return sum(n for i, n in stages().items() if i not in before) / (100 * 20_000)  # times the texts

    assert shuffled(lambda: run(samples=2)) < 1.5
    assert shuffled(lambda: run(samples=2).agg(F.sum(F.length("prompt"))).collect()) < 0.1


def test_samples_asked_for_later(spark, tmp_path):
    """More samples, more than a batch of them, more rows and a repeated key: only what is missing is generated, and a wave stays a wave."""
    calls = str(tmp_path / "calls")

    def make():
        def generate(prompts):
            with open(calls, "a") as f:
                f.write("".join(f"{p}\n" for p in prompts))
            return [f"<{p}>" for p in prompts]

        return generate

    run = lambda rows, **k: generation_run(spark.createDataFrame(rows, "id long, text string"), "id", F.col("text"), make, f"file://{tmp_path}/store", batch=4, tasks=3, **k)
    rows = [(i, f"p{i}") for i in range(5)]
    assert run(rows, samples=2, wave=4).count() == 10
    files = lambda: set(spark.read.parquet(f"{tmp_path}/store").select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    early = files()
    got = run([*rows, (9, "q9"), (9, "p9")], samples=30, wave=20).groupBy("key", "prompt", "generation").agg(F.count_distinct("sample").alias("n"), F.count("*").alias("all")).collect()
    assert sorted((r.key, r.prompt, r.generation, r.n, r["all"]) for r in got) == [(str(i), f"p{i}", f"<p{i}>", 30, 30) for i in (*range(5), 9)]
    assert open(calls).read().count("\n") == 6 * 30  # none twice
    sizes = spark.read.parquet(*(files() - early)).groupBy(F.regexp_extract(F.input_file_name(), "part-[0-9]+-(.+)-c[0-9]", 1)).count().collect()
    assert max(r["count"] for r in sizes) <= 20 and sum(r["count"] for r in sizes) == 170


def test_retries():
    waits, calls = [], []

    def generate(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise RuntimeError("busy")
        return ["t"] * len(prompts)

    assert in_batches(["a", "b"], generate, 3, 1.0, waits.append) == [("t", None, 3)] * 2 and waits == [1.0, 2.0]
    bad = lambda prompts: 1 / 0 if "b" in prompts else prompts
    assert in_batches(["a", "b", "c"], bad, 1, 0.0, waits.append) == [("a", None, 1), (None, "ZeroDivisionError: division by zero", 1), ("c", None, 1)]
    assert in_batches(["a"], lambda p: [], 0, 0.0)[0][0] is None


@pytest.mark.parametrize("left", [False, True])
def test_dummy_media(spark, left):
    rows = [(1, 1, [1], [1], [1], None, None, None, "x"), (1, 2, [2], [1], [2], [], None, ["a"], "x"), (2, 1, [3], [1], [3], None, ["v"], None, "x"), (2, 0, [4, 4], [1, 1], [4, 4], None, None, None, "x"), (3, 5, [5], [1], [5], ["i"], None, ["a"], "x")]
    df = spark.createDataFrame(rows, "batch int, k int, input_ids array<int>, attention_mask array<int>, labels array<int>, _images array<string>, _videos array<string>, _audios array<string>, seen string")
    got = {(r.batch, r.k): r for r in with_dummy_media(df, "batch", "k", [7, 8], [9], left).collect()}
    join = lambda a, b: b + a if left else a + b
    assert got[1, 1].input_ids == join([1], [7, 8]) and got[1, 1].labels == join([1], [IGNORE] * 2) and got[1, 1].attention_mask == join([1], [0, 0]) and got[1, 1]._images == ["dummy"] and got[1, 1]._audios is None
    assert got[2, 0].input_ids == join([4, 4], [9]) and got[2, 0]._audios == ["dummy"] and got[2, 0]._images is None
    assert [got[k].input_ids for k in ((1, 2), (2, 1), (3, 5))] == [[2], [3], [5]] and got[1, 2].seen == "x"
    assert {k: r.input_ids for k, r in ((k, r) for k, r in got.items())}.keys() == {(1, 1), (1, 2), (2, 0), (2, 1), (3, 5)}
    assert {tuple(r.input_ids) for r in with_dummy_media(df, "batch", "k").collect()} == {tuple(r[2]) for r in rows}


def test_programs_share_an_interpreter(monkeypatch):
    """Twenty programs start one interpreter; a program that ends it costs a new one, and nothing of a program is left for the next."""
    import subprocess
    from contextlib import closing

    from textloom.operators import runner

    started = []
    plain = subprocess.Popen
    monkeypatch.setattr(runner.subprocess, "Popen", lambda *a, **k: started.append(a) or plain(*a, **k))
    with closing(runner.Launcher()) as launcher:
        run = lambda code, given="": runner.run_program(code, "python", given, launcher=launcher)
        assert [run("import os; x = int(input()); os.chdir('/'); print(x * 2)", str(i)).output for i in range(20)] == [f"{2 * i}\n" for i in range(20)]
        assert len(started) == 1
        assert run("print('x' in globals(), __import__('sys').argv[0].endswith('/program'))").output == "False True\n"
        assert run("import os, signal; os.kill(os.getppid(), signal.SIGKILL)").status == "RE"
        assert run("print(1)").output == "1\n" and len(started) == 2
        assert run("import atexit; atexit.register(print, 'bye')").output == "bye\n"
        assert run("raise SystemExit(3)").status == "RE" and run("raise SystemExit").status == "OK"
