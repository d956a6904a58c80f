"""Operators with an effect outside of Spark: running code against tests, and asking a judge. Neither is on any other path."""

from __future__ import annotations

import hashlib
import json
import subprocess
import sys
import time
from collections.abc import Callable, Iterator

from typing import TypeVar

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring

T = TypeVar("T")

#: Scores of programs that a task remembers, by their digests.
KNOWN = 100_000
#: An interpreter in isolated mode that has done nothing yet and runs programs in forks of itself: starting an interpreter is
#: most of what a short program costs. Its input has a JSON line for each program, its output a line for each score. A fork
#: leaves the loop and runs the program as its main module, so that it ends as any interpreter does.
_SERVER = """
def _serve():
    import json, os, resource, select, shutil, signal, sys, tempfile
    seconds, megabytes = int(sys.argv[1]), int(sys.argv[2])
    source, sink = sys.stdin.buffer, os.dup(1)
    nothing = os.open(os.devnull, os.O_RDWR)
    os.dup2(nothing, 1)
    os.dup2(nothing, 2)
    for line in source:
        program = json.loads(line)
        folder = tempfile.mkdtemp()
        pid = os.fork()
        if not pid:
            os.setsid()
            os.chdir(folder)
            os.dup2(nothing, 0)
            os.close(sink)
            resource.setrlimit(resource.RLIMIT_CPU, (2 * seconds + 5, 2 * seconds + 5))  # for threads; time is up before
            resource.setrlimit(resource.RLIMIT_AS, (megabytes << 20, megabytes << 20))
            resource.setrlimit(resource.RLIMIT_FSIZE, (1 << 20, 1 << 20))
            os.environ.clear()
            sys.argv[:] = ["-c"]
            return program
        ended = os.pidfd_open(pid)
        in_time = bool(select.select([ended], [], [], seconds)[0])
        os.close(ended)
        for kill in (lambda: os.killpg(pid, signal.SIGKILL), lambda: os.kill(pid, signal.SIGKILL)):  # and what it has started itself
            try:
                kill()
            except OSError:
                pass
        code = os.waitstatus_to_exitcode(os.waitpid(pid, 0)[1])
        shutil.rmtree(folder, ignore_errors=True)
        out_of_time = not in_time or code in (-signal.SIGXCPU, -signal.SIGKILL)
        os.write(sink, b"0\\n" if out_of_time else b"5\\n" if code == 0 else b"1\\n")
    os._exit(0)

_program = _serve()
del _serve
exec(compile(globals().pop("_program"), "<string>", "exec"))
"""


class _Runner:
    """Programs run one after the other by a server of their task, which is started anew should a program bring it down."""

    def __init__(self, seconds: int, megabytes: int) -> None:
        self.command, self.server = [sys.executable, "-I", "-c", _SERVER, str(seconds), str(megabytes)], None

    def run(self, program: str) -> float:
        if "\0" in program:
            return 0.0
        line = json.dumps(program).encode() + b"\n"
        if self.server is None:
            self.server = subprocess.Popen(self.command, env={}, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        try:
            self.server.stdin.write(line)
            self.server.stdin.flush()
            told = self.server.stdout.readline()
        except OSError:
            told = b""
        if not told:
            self.close()
            return 0.0
        return float(told)

    def close(self) -> None:
        if self.server is not None:
            self.server.kill()
            self.server.communicate()
            self.server = None


def unit_tests(rows: DataFrame, enabled: bool = False, seconds: int = 10, megabytes: int = 512) -> DataFrame:
    """rows (response, test_code) with `unit_score`: 5 if the code and its tests run through, 1 if they fail, 0 if they don't end in time.

    Code is run in a process of its own, a fork of a fresh interpreter in isolated mode, in a folder of its own, without
    environment and with limits on time, memory and files. A task runs rows with the same code and tests once; one that
    didn't end in time is tried again with each. That is no sandbox against malice: it is off unless asked for.
    """
    if not enabled:
        raise PermissionError("running untrusted code must be asked for: enabled=True")
    prepared = rows.withColumn("__code", scoring.code(F.col("response")))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "unit_score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runner, known = _Runner(seconds, megabytes), {}

        def score(code: str | None, tests: str | None) -> float | None:
            if code is None or tests is None:
                return None
            program = f"{code}\n\n{tests}\n"
            key = hashlib.sha256(program.encode("utf-8", "surrogatepass")).digest()
            if (told := known.get(key)) is None:
                told = runner.run(program)
                if len(known) >= KNOWN:
                    known.clear()
                if told:
                    known[key] = told
            return told

        try:
            for b in batches:
                scores = [score(c, t) for c, t in zip(b["__code"], b["test_code"], strict=True)]
                yield b.drop(columns="__code").assign(unit_score=scores)
        finally:
            runner.close()

    return prepared.mapInPandas(run, schema)


def retried(call: Callable[[], T], attempts: int = 3, wait: float = 2.0, errors: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep: Callable[[float], None] = time.sleep) -> T:
    """What a call gives, tried again after errors of transport, with twice the wait each time; the last error is raised, so that a failure never becomes a row."""
    for n in range(attempts):
        try:
            return call()
        except errors:
            if n + 1 == attempts:
                raise
            sleep(wait * 2**n)
    raise ValueError("attempts must be 1 or more")


def judged(pairs: DataFrame, primary: Callable[[str], str | None], second: Callable[[str], str | None] | None = None) -> DataFrame:
    """pairs (.., prompt) with `answer` and `judge`: what the primary judge says, or where it says nothing the second; pairs without an answer go."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pairs.dtypes), "answer string, judge string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, judges = [], []
            for p in b["prompt"]:
                answer, judge = primary(p), "primary"
                if not answer and second:
                    answer, judge = second(p), "second"
                answers.append(answer or None)
                judges.append(judge)
            yield b.assign(answer=answers, judge=judges)

    return pairs.mapInPandas(run, schema).where("answer is not null")


def recorded(pairs: DataFrame, verdicts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """The offline judge: answers on record, the primary one or else the tie-break. verdicts: key, primary_answer, tiebreak_answer."""
    joined = pairs.join(verdicts, key).withColumn("answer", F.coalesce(F.nullif("primary_answer", F.lit("")), F.nullif("tiebreak_answer", F.lit(""))))
    return joined.where("answer is not null").drop("primary_answer", "tiebreak_answer")
