"""Tasks with a time limit, that a signal can cancel, and progress that ends with it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from parsefold.functions import fixed_values as v


class Cancelled(Exception):
    pass


class Signal:
    """Set once; whoever waits learns of it."""

    def __init__(self):
        self._set = threading.Event()
        self._told: list[Callable[[], None]] = []

    @property
    def aborted(self) -> bool:
        return self._set.is_set()

    def abort(self) -> None:
        self._set.set()
        for f in list(self._told):
            f()

    def listen(self, f: Callable[[], None]) -> None:
        self._told.append(f)

    def forget(self, f: Callable[[], None]) -> None:
        if f in self._told:
            self._told.remove(f)

    def check(self) -> None:
        if self.aborted:
            raise Cancelled("Import canceled")


def abortable(task: Callable[[], Any], signal: Signal, timeout_ms: int | None = v.TASK_TIMEOUT_MS) -> Any:
    """The first of: the task's value or error, the signal, the time limit (None: none). A
    task that never ends is left behind on its own thread."""
    done, result = threading.Event(), {}

    def work() -> None:
        try:
            result["value"] = task()
        except Exception as e:  # noqa: BLE001  handed to the caller
            result["error"] = e
        done.set()

    signal.listen(done.set)
    try:
        signal.check()
        threading.Thread(target=work, daemon=True).start()
        in_time = done.wait(None if timeout_ms is None else timeout_ms / 1000)
        if "value" in result:
            return result["value"]
        if "error" in result:
            raise result["error"]
        signal.check()
        if not in_time:
            raise TimeoutError(v.TIMED_OUT)
    finally:
        signal.forget(done.set)


def reporter(signal: Signal, progress: Callable[[str, int], None]) -> Callable[[str, int], None]:
    """progress(message, percent), silent once the signal is set."""
    return lambda message, percent: None if signal.aborted else progress(message, percent)


def run_job(spark: SparkSession, work: Callable[[], Any], signal: Signal, progress: Callable[[str, int], None] | None = None, message: str = "", timeout_ms: int | None = None, every_s: float = 0.2, share: Callable[[], int] | None = None) -> Any:
    """work(), whose Spark jobs carry a tag: they are cancelled when the signal is set or the
    time is over. progress(message, percent of the tasks begun that are done, or what share()
    gives) is told every every_s seconds, and nothing any more once the signal is set."""
    sc, tag = spark.sparkContext, f"parsefold-{uuid.uuid4().hex}"
    ended = threading.Event()
    told = reporter(signal, progress or (lambda message, percent: None))

    def tagged() -> Any:
        sc.addJobTag(tag)
        try:
            return work()
        finally:
            sc.removeJobTag(tag)

    def watch() -> None:
        tracker = sc._jsc.sc().statusTracker()
        while not ended.wait(every_s):
            if share is not None:
                told(message, share())
                continue
            stages = [s for j in tracker.getJobIdsForTag(tag) if tracker.getJobInfo(j).isDefined() for s in tracker.getJobInfo(j).get().stageIds()]
            infos = [x.get() for x in map(tracker.getStageInfo, stages) if x.isDefined()]
            total = sum(i.numTasks() for i in infos)
            told(message, round(100 * sum(i.numCompletedTasks() for i in infos) / total) if total else 0)

    told(message, 0)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        value = abortable(tagged, signal, timeout_ms)
    except (Cancelled, TimeoutError):
        sc.cancelJobsWithTag(tag)
        raise
    finally:
        ended.set()
        watcher.join()
    told(message, 100)
    return value
