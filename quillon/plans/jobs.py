"""Task graphs and a job registry on the driver: each task is a function that submits Spark work; dependencies run first, the rest side by side."""

from __future__ import annotations

import itertools
import threading
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class CircularDependency(ValueError):
    """The tasks depend on each other in a circle."""


def task_order(tasks: Mapping[str, Sequence[str]]) -> list[str]:
    """Tasks after all that they depend on; ties by name."""
    try:
        sorter = TopologicalSorter({t: sorted(d) for t, d in sorted(tasks.items())})
        return list(sorter.static_order())
    except CycleError as e:
        raise CircularDependency(str(e.args[1])) from None


def run_stages(df: DataFrame, stages: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """A left fold of transformations."""
    return reduce(lambda d, f: d.transform(f), stages, df)


@dataclass
class Job:
    """tasks: name to (function of the results of its dependencies, dependencies)."""

    id: int
    user: str
    tasks: dict[str, tuple[Callable[..., Any], Sequence[str]]]
    status: str = "new"
    futures: dict[str, Future] = field(default_factory=dict)

    def check(self) -> str:
        if self.status == "running" and all(f.done() for f in self.futures.values()):
            self.status = "failed" if any(f.exception() for f in self.futures.values()) else "done"
        return self.status


class Jobs:
    """Add, start, check, wait for, list, cancel and delete jobs. Each job's Spark work carries a job group, by which it can be cancelled."""

    def __init__(self, spark: SparkSession | None = None, workers: int = 8) -> None:
        self.spark, self.pool = spark, ThreadPoolExecutor(workers)
        self.jobs: dict[int, Job] = {}
        self.ids = itertools.count(1)
        self.lock = threading.Lock()

    def add(self, user: str, tasks: Mapping[str, tuple[Callable[..., Any], Sequence[str]]]) -> int:
        task_order({name: deps for name, (_, deps) in tasks.items()})
        with self.lock:
            job = Job(next(self.ids), user, dict(tasks))
            self.jobs[job.id] = job
        return job.id

    def start(self, job_id: int) -> None:
        job = self.jobs[job_id]
        order = task_order({name: deps for name, (_, deps) in job.tasks.items()})
        job.status = "running"

        def run(name: str) -> Any:
            f, deps = job.tasks[name]
            if self.spark is not None:
                self.spark.sparkContext.setJobGroup(f"quillon-{job.id}", f"{job.user}: {name}", True)
            return f(*(job.futures[d].result() for d in deps))

        for name in order:  # dependencies are submitted first, so a waiting task never holds up what it waits for
            job.futures[name] = self.pool.submit(run, name)

    def start_all(self, user: str | None = None) -> None:
        for j in self.list(user, "new"):
            self.start(j)

    def check(self, job_id: int) -> str:
        return self.jobs[job_id].check()

    def check_all(self, user: str | None = None) -> dict[int, str]:
        return {j: self.check(j) for j in self.list(user)}

    def result(self, job_id: int, task: str, wait: bool = True) -> Any:
        f = self.jobs[job_id].futures[task]
        return f.result() if wait else (f.result() if f.done() else None)

    def results(self, job_id: int) -> dict[str, Any]:
        """Every task's result, or its exception as a value."""
        return {name: (f.exception() or f.result()) for name, f in self.jobs[job_id].futures.items()}

    def list(self, user: str | None = None, status: str | None = None) -> list[int]:
        return [j.id for j in self.jobs.values() if user in (None, j.user) and status in (None, j.check())]

    def cancel(self, job_id: int) -> None:
        for f in self.jobs[job_id].futures.values():
            f.cancel()
        if self.spark is not None:
            self.spark.sparkContext.cancelJobGroup(f"quillon-{job_id}")
        self.jobs[job_id].status = "cancelled"

    def delete_done(self, user: str | None = None) -> int:
        gone = [j for j in self.list(user) if self.check(j) in ("done", "failed", "cancelled")]
        for j in gone:
            del self.jobs[j]
        return len(gone)


def caught(f: Callable[..., Any], *args: Any) -> Any:
    """f's result, or what went wrong as a value."""
    try:
        return f(*args)
    except Exception as e:  # the caller asked for exceptions as values
        return {"error": type(e).__name__, "message": str(e)}
