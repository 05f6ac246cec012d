"""Running generated programs against their tests. Off unless asked for: it executes untrusted code."""

from __future__ import annotations

import subprocess
import sys
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from millrace import config as C


def at_most(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` dealt to so many partitions, so no more than that many tasks work on it at once (requests, downloads, programs)."""
    return df.repartition(tasks)


def check_correctness(programs: DataFrame, timeout_s: float = 3.0, allow_untrusted_code: bool = False, at_once: int = C.EvalConfig.programs_at_once) -> DataFrame:
    """``task_id, completion_id, passed, result`` of ``(task_id, completion_id, program)``.

    Each program runs in an interpreter of its own, isolated from the environment and site packages, in an empty
    folder, under limits of time, memory and file size, at most ``at_once`` at a time. This bounds accidents; it is no sandbox.
    """
    if not allow_untrusted_code:
        raise PermissionError("set allow_untrusted_code to run generated programs")
    kinds = dict(programs.dtypes)
    names = ["task_id", "completion_id", "passed", "result"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [run_program(p, timeout_s) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r == "passed" for r in results]), pa.array(results)], names=names)

    return at_most(programs.select("task_id", "completion_id", "program"), at_once).mapInArrow(run, f"task_id {kinds['task_id']}, completion_id {kinds['completion_id']}, passed boolean, result string")


_LIMITS = "import resource as r\nr.setrlimit(r.RLIMIT_AS,(1<<30,1<<30))\nr.setrlimit(r.RLIMIT_FSIZE,(1<<20,1<<20))\nr.setrlimit(r.RLIMIT_NPROC,(64,64))\ndel r\n"


def run_program(program: str, timeout_s: float) -> str:
    """``passed``, ``timed out`` or ``failed: `` and the error's last line."""
    with tempfile.TemporaryDirectory() as folder:
        try:
            done = subprocess.run([sys.executable, "-I", "-c", _LIMITS + program], cwd=folder, env={}, capture_output=True, text=True, timeout=timeout_s)
        except subprocess.TimeoutExpired:
            return "timed out"
    if done.returncode == 0:
        return "passed"
    return "failed: " + (done.stderr.strip().splitlines() or [f"exit {done.returncode}"])[-1]
