"""Declarative datasets with expectations, and a task-graph runner."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from ..operators.rows import expect
from ..sources.table import SnapshotTable


@dataclass
class Dataset:
    build: Callable[[Registry], DataFrame]
    kind: str = "view"
    comment: str = ""
    properties: dict[str, str] = field(default_factory=dict)
    drop: dict[str, str] = field(default_factory=dict)
    warn: dict[str, str] = field(default_factory=dict)


class Registry:
    """Datasets by name. ``read`` builds a dataset on first use, so reads define
    the graph; tables are stored under ``root``, views stay plans."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root
        self.datasets: dict[str, Dataset] = {}
        self._built: dict[str, DataFrame] = {}
        self._building: list[str] = []
        self.edges: set[tuple[str, str]] = set()
        self.reports: dict[str, DataFrame] = {}

    def dataset(self, name: str, kind: str = "view", comment: str = "", drop: dict[str, str] | None = None, warn: dict[str, str] | None = None, **properties: str):
        if kind not in ("view", "table"):
            raise ValueError(f"unknown kind {kind!r}")

        def register(f: Callable[[Registry], DataFrame]):
            self.datasets[name] = Dataset(f, kind, comment, properties, drop or {}, warn or {})
            return f

        return register

    def read(self, name: str) -> DataFrame:
        if self._building:
            self.edges.add((name, self._building[-1]))
        if name in self._building:
            raise ValueError(f"datasets read each other: {[*self._building, name]}")
        if name not in self._built:
            d = self.datasets[name]
            self._building.append(name)
            try:
                df = d.build(self)
            finally:
                self._building.pop()
            if d.drop or d.warn:
                df, self.reports[name] = expect(df, d.drop, d.warn)
            if d.kind == "table" and self.root:
                table = SnapshotTable(self.spark, f"{self.root}/{name}")
                table.overwrite(df, inputs=sorted(a for a, b in self.edges if b == name), comment=d.comment, properties=d.properties)
                df = table.read()
            self._built[name] = df
        return self._built[name]


@dataclass
class Task:
    name: str
    run: Callable[[], object]
    depends_on: tuple[str, ...] = ()
    retries: int = 0


class TaskFailed(RuntimeError):
    pass


def run_dag(tasks: list[Task], timeout_s: float = 3600, parallel: int = 4) -> dict[str, tuple[object, int]]:
    """Run a task once all it depends on succeeded, independent ones at once.
    name -> (result, attempts). A task that fails after its retries, or the time
    being up, fails the run once the running tasks have ended."""
    by_name = {t.name: t for t in tasks}
    graph = TopologicalSorter({t.name: t.depends_on for t in tasks})
    graph.prepare()
    if unknown := {d for t in tasks for d in t.depends_on} - by_name.keys():
        raise ValueError(f"unknown tasks: {sorted(unknown)}")

    def attempt(t: Task) -> tuple[object, int]:
        for k in range(t.retries + 1):
            try:
                return t.run(), k + 1
            except Exception:
                if k == t.retries:
                    raise

    done: dict[str, tuple[object, int]] = {}
    deadline = time.monotonic() + timeout_s
    with ThreadPoolExecutor(parallel) as pool:
        running = {}
        while graph.is_active():
            for name in graph.get_ready():
                running[pool.submit(attempt, by_name[name])] = name
            finished, _ = wait(running, timeout=max(0, deadline - time.monotonic()), return_when=FIRST_COMPLETED)
            if not finished:
                raise TaskFailed(f"time is up; still running: {sorted(running.values())}")
            for f in finished:
                name = running.pop(f)
                if f.exception():
                    raise TaskFailed(f"task {name} failed: {f.exception()}") from f.exception()
                done[name] = f.result()
                graph.done(name)
    return done
