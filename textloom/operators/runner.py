"""Programs run on test cases in bounded processes of a task: CPU, memory, output and wall time are limited, and a process group that goes on is killed.

The limits keep a program from harming the job, not from doing harm: programs that are not trusted belong on executors that
hold nothing else (a container without network and secrets).
"""

from __future__ import annotations

import json
import signal
import subprocess
import sys
import tempfile
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path
from queue import SimpleQueue

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..ship import ship
from .scorer import provider

#: Interpreters; Python programs run in the process that has set its limits.
LANGUAGES = {"python": None, "python3": None, "sh": "/bin/sh"}
# A process without threads that forks one process for each request, which sets its limits itself and goes on as the program:
# the interpreter starts once for many programs. Requests and answers are lines on its own stdin and stdout; a program has files there.
_LAUNCH = """import atexit, gc, io, json, os, resource as r, select, signal, sys
gc.collect()
gc.freeze()
rest = b""
while True:
    while b"\\n" not in rest:
        part = os.read(0, 1 << 16)
        if not part:
            os._exit(0)
        rest += part
    line, rest = rest.split(b"\\n", 1)
    top, wait, limits, shell = json.loads(line)
    pid = os.fork()
    if not pid:
        break
    try:
        fd = os.pidfd_open(pid)
        try:
            poll = select.poll()
            poll.register(fd, select.POLLIN)
            late = not poll.poll(wait * 1000)
        finally:
            os.close(fd)
    finally:
        for kill in (os.killpg, os.kill):  # children, too
            try:
                kill(pid, signal.SIGKILL)
            except ProcessLookupError:
                pass
        status = os.waitpid(pid, 0)[1]
    os.write(1, json.dumps([os.waitstatus_to_exitcode(status), late]).encode() + b"\\n")
os.setsid()
os.chdir(top)
for fd, (name, how) in enumerate((("in", os.O_RDONLY), ("out", os.O_WRONLY | os.O_CREAT), ("err", os.O_WRONLY | os.O_CREAT))):
    file = os.open(name, how, 0o644)
    os.dup2(file, fd)
    os.close(file)
sys.stdin = sys.__stdin__ = io.TextIOWrapper(open(0, "rb", closefd=False), sys.stdin.encoding, sys.stdin.errors)
program = os.path.join(top, "program")
for k, v in zip((r.RLIMIT_CPU, r.RLIMIT_AS, r.RLIMIT_FSIZE, r.RLIMIT_CORE), (*limits, 0)):
    r.setrlimit(k, (v, v))
if shell:
    os.execv(shell, [shell, program])
sys.argv = [program]
with open(program, "rb") as f:
    code = f.read()
del r, rest, part, line, top, wait, limits, pid, fd, name, how, file, k, v, shell, f
own = {"__name__": "__main__", "__file__": program}
status = 0
try:
    exec(compile(code, program, "exec"), own)
except SystemExit as e:
    status = 0 if e.code is None else e.code & 255 if isinstance(e.code, int) else 1
    if e.code is not None and not isinstance(e.code, int):
        print(e.code, file=sys.stderr)
except BaseException:
    status = 1
    sys.excepthook(*sys.exc_info())
try:  # as at the end of an interpreter, without taking down what it had before the program
    if "threading" in sys.modules:
        sys.modules["threading"]._shutdown()
    atexit._run_exitfuncs()
    own.clear()
    gc.collect()
    sys.stdout.flush()
    sys.stderr.flush()
except BaseException:
    status = status or 120
os._exit(status)
"""


@dataclass(frozen=True)
class Limits:
    seconds: float = 5.0
    memory_mb: int = 512
    output_bytes: int = 1 << 20
    processes: int = 4  # at a time, in each task


@dataclass(frozen=True)
class Outcome:
    """status: OK, RE (it failed), TLE, MLE or OLE (too much time, memory, output); what it wrote."""

    status: str
    output: str
    errors: str


class Launcher:
    """Starts programs from one process (:data:`_LAUNCH`), one at a time; a program that ends this process costs a new one only."""

    def __init__(self):
        self._process: subprocess.Popen | None = None

    def run(self, top: str, limits: Limits, shell: str | None) -> tuple[int, bool]:
        """(exit code or -signal, whether it was too late) of the program in the folder ``top``."""
        asked = [top, limits.seconds, [int(limits.seconds) + 1, limits.memory_mb << 20, limits.output_bytes], shell]
        if self._process is None:
            command = [sys.executable, "-I", "-S", "-c", _LAUNCH]
            env = {"PATH": "/usr/bin:/bin", "LANG": "C.UTF-8"}
            self._process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, cwd="/", env=env, start_new_session=True)
        p = self._process
        try:
            p.stdin.write(json.dumps(asked).encode() + b"\n")
            p.stdin.flush()
            line = p.stdout.readline()
        except BrokenPipeError:
            line = b""
        if not line.endswith(b"\n"):
            self.close()
            return 1, False
        code, late = json.loads(line)
        return code, late

    def close(self) -> None:
        if self._process is not None:
            p, self._process = self._process, None
            p.kill()
            p.stdout.close()
            try:
                p.stdin.close()
            except BrokenPipeError:
                pass
            p.wait()


def run_program(code: str, language: str, stdin: str = "", limits: Limits = Limits(), launcher: Launcher | None = None) -> Outcome:
    """Runs a program in an empty folder of its own; its output goes to files, so that no pipe can fill the task's memory.

    ``launcher``: for many programs; else one is started for this program.
    """
    if language not in LANGUAGES:
        return Outcome("RE", "", f"no interpreter for {language}")
    if launcher is None:
        with closing(Launcher()) as launcher:
            return run_program(code, language, stdin, limits, launcher)
    with tempfile.TemporaryDirectory(prefix="run-") as top:
        program, given, out, err = (Path(top) / n for n in ("program", "in", "out", "err"))
        program.write_text(code, "utf-8", errors="replace")
        given.write_text(stdin, "utf-8")
        out.touch()
        err.touch()
        status, late = launcher.run(top, limits, LANGUAGES[language])
        output, errors = (x.read_bytes().decode("utf-8", "replace") for x in (out, err))
        if late or status == -signal.SIGXCPU:
            return Outcome("TLE", output, errors)
        if status == -signal.SIGXFSZ or out.stat().st_size >= limits.output_bytes:
            return Outcome("OLE", output, errors)
        if status and ("MemoryError" in errors[-2000:] or "Cannot allocate memory" in errors[-2000:]):
            return Outcome("MLE", output, errors)
        return Outcome("OK" if status == 0 else "RE", output, errors)


def same_output(said: str, wanted: str) -> bool:
    """Line by line, without white space at the ends of lines and empty lines at the end."""
    lines = lambda t: "\n".join(x.rstrip() for x in t.splitlines()).rstrip("\n")
    return lines(said) == lines(wanted)


def judge(code: str | None, language: str | None, cases: Sequence[tuple[str, str]], limits: Limits = Limits(), batch: int = 4, to_end: bool = False, launcher: Launcher | None = None) -> tuple[float, str, int]:
    """(share of the cases passed, verdict, cases run). The verdict is AC, or WA, RE, TLE, MLE, OLE of the first case that failed.

    Cases run ``batch`` at a time; after a batch with a failure the rest is not run, unless ``to_end``. Without a program or cases: (0, CE, 0).
    """
    if not code or not language or not cases:
        return 0.0, "CE", 0
    passed = run = 0
    verdict = "AC"
    for at in range(0, len(cases), batch):
        for given, wanted in cases[at : at + batch]:
            done = run_program(code, language, given or "", limits, launcher)
            good = done.status == "OK" and same_output(done.output, wanted or "")
            passed, run = passed + good, run + 1
            if not good and verdict == "AC":
                verdict = "WA" if done.status == "OK" else done.status
        if verdict != "AC" and not to_end:
            break
    return passed / len(cases), verdict, run


_JUDGED = StructType([StructField("score", DoubleType()), StructField("verdict", StringType()), StructField("run", IntegerType())])


def with_judgment(rows: DataFrame, code: str, language: str, cases: str, out: str = "judged", limits: Limits = Limits(), batch: int = 4, to_end: bool = False) -> DataFrame:
    """Adds ``out``: struct<score, verdict, run> (:func:`judge`) of each row's program on its cases, array<struct<input, output>>; ``limits.processes`` programs at a time in each task.

    A task need not judge equal programs on equal cases again.
    """
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idle: SimpleQueue[Launcher] = SimpleQueue()
        launchers = [Launcher() for _ in range(limits.processes)]
        for x in launchers:
            idle.put(x)

        known: dict[tuple, tuple[float, str, int]] = {}

        def one(row: tuple) -> dict:
            source, name, tests = row
            some = () if tests is None else tuple((t["input"], t["output"]) for t in tests)
            asked = (source, name, some)
            done = known.get(asked)
            if done is None:
                launcher = idle.get()
                try:
                    done = judge(source, name, some, limits, batch, to_end, launcher)
                finally:
                    idle.put(launcher)
                if len(known) >= 10_000:
                    known.clear()
                known[asked] = done
            return dict(zip(("score", "verdict", "run"), done, strict=True))

        try:
            with ThreadPoolExecutor(limits.processes) as pool:
                for b in batches:
                    yield b.assign(**{out: list(pool.map(one, zip(b[code], b[language], b[cases], strict=True)))})
        finally:
            for x in launchers:
                x.close()

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(out, _JUDGED)]))


@provider("local")
def run_script(code: str, language: str) -> float:
    """For :func:`~.scorer.executed`: the number that a script prints last."""
    done = run_program(code, language)
    if done.status != "OK":
        raise RuntimeError(done.status)
    return float(done.output.split()[-1])


CASES = ArrayType(StructType([StructField("input", StringType()), StructField("output", StringType())]))
