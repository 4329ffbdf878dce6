"""Requests with a life of their own: begun, waited for, cancelled.

A request runs its plan in a thread of its own, whose Spark jobs bear the request's tag; cancelling it stops these jobs and no others. Several
requests run side by side.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable

from pyspark import InheritableThread, SparkContext
from pyspark.sql import DataFrame, Row

NEW, RUNNING, DONE, FAILED, CANCELLED = "new", "running", "done", "failed", "cancelled"


class Request:
    """A plan to be run: a DataFrame, or a function that makes one. ``path`` names where its rows go as Parquet; without one they are held
    here, which is for results of a bounded size."""

    def __init__(self, plan: DataFrame | Callable[[], DataFrame], path: str | None = None):
        self.plan, self.path, self.state, self.error = plan, path, NEW, None
        self.tag = f"request-{uuid.uuid4().hex}"
        self._rows: list[Row] = []
        self._lock, self._over = threading.Lock(), threading.Event()
        self._context = plan.sparkSession.sparkContext if isinstance(plan, DataFrame) else SparkContext.getOrCreate()

    def begin(self) -> Request:
        with self._lock:
            if self.state != NEW:
                raise RuntimeError(f"the request is {self.state}")
            self.state = RUNNING
        InheritableThread(target=self._run, daemon=True).start()
        return self

    def _run(self) -> None:
        try:
            self._context.addJobTag(self.tag)
            df = self.plan if isinstance(self.plan, DataFrame) else self.plan()
            if self.path:
                df.write.mode("overwrite").parquet(self.path)
            else:
                self._rows = df.collect()
            self._end(DONE)
        except Exception as e:  # the thread ends here; whoever waits gets the error
            self._end(FAILED, e)
        finally:
            self._over.set()

    def _end(self, state: str, error: Exception | None = None) -> None:
        with self._lock:
            if self.state == RUNNING:
                self.state, self.error = state, error

    def wait(self, seconds: float | None = None) -> str:
        """The state when the request is over, or after so many seconds."""
        if self.state == NEW:
            raise RuntimeError("the request hasn't begun")
        self._over.wait(seconds)
        return self.state

    def cancel(self) -> None:
        """Stop the request's jobs; its rows are dropped. One that is over stays as it is."""
        with self._lock:
            if self.state not in (NEW, RUNNING):
                return
            begun, self.state = self.state == RUNNING, CANCELLED
        if begun:
            self._context.cancelJobsWithTag(self.tag)
        else:
            self._over.set()

    def rows(self) -> list[Row]:
        """The rows of a request that is done; its error is raised if it failed."""
        if self.state == FAILED:
            raise self.error
        if self.state != DONE:
            raise RuntimeError(f"the request is {self.state}")
        return self._rows


def begin_all(requests: Iterable[Request]) -> list[Request]:
    return [r.begin() for r in requests]


def wait_all(requests: Iterable[Request], seconds: float | None = None) -> list[str]:
    """The states of all requests when they are over, or after so many seconds in all."""
    end = None if seconds is None else time.monotonic() + seconds
    return [r.wait(None if end is None else max(0.0, end - time.monotonic())) for r in requests]
