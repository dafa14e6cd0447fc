"""Runs side by side and runs that are stopped: threads of the driver that submit Spark jobs.

Every run has a thread of its own with the caller's properties, a scheduler pool (which counts if the
session was started with ``spark.scheduler.mode=FAIR``) and, if it has a limit, a job tag. When the
limit is over, a timer cancels the jobs of the tag, and goes on to do so until the run's thread has
noticed: a run is between two jobs at times. What runs on the driver alone is not cut short.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

T = TypeVar("T")
#: Seconds between two looks for jobs of a run whose time is over.
AGAIN = 0.2


def limited(spark: SparkSession, work: Callable[[], T], seconds: float | None) -> T:
    """What ``work`` returns; its jobs are cancelled once ``seconds`` are over, and TimeoutError is raised."""
    if seconds is None:
        return work()
    context, tag, done, over = spark.sparkContext, f"run-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if done.wait(seconds):
            return
        over.set()
        while not done.is_set():
            context.cancelJobsWithTag(tag)
            done.wait(AGAIN)

    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    began = time.time()
    try:
        result = work()
    except Exception as error:
        if over.is_set():
            raise TimeoutError(f"stopped after {time.time() - began:.1f} s of {seconds:.1f}") from error
        raise
    finally:
        done.set()
        watcher.join()
        context.removeJobTag(tag)
    if over.is_set():
        raise TimeoutError(f"ended after {time.time() - began:.1f} s of {seconds:.1f}")
    return result


def side_by_side(spark: SparkSession, works: Iterable[Callable[[], T]], workers: int = 1, limit: float | None = None, start_until: float | None = None) -> list[T | Exception]:
    """Results in the order of ``works``, at most ``workers`` at a time; a failure is its exception.

    ``limit``: seconds of each. ``start_until``: a time after which no further one starts; those are left out.
    """
    works = list(works)

    def one(n: int, work: Callable[[], T]) -> T | Exception | None:
        if start_until is not None and time.time() > start_until:
            return None
        context = spark.sparkContext
        before = context.getLocalProperty("spark.scheduler.pool")
        context.setLocalProperty("spark.scheduler.pool", f"run-{n % max(1, workers)}")
        try:
            return limited(spark, work, limit)
        except Exception as error:  # the caller decides what a failure means
            return error
        finally:
            context.setLocalProperty("spark.scheduler.pool", before)

    if workers <= 1 or len(works) <= 1:
        found = [one(n, w) for n, w in enumerate(works)]
    else:
        with ThreadPoolExecutor(min(workers, len(works))) as pool:
            found = [f.result() for f in [pool.submit(inheritable_thread_target(spark)(one), n, w) for n, w in enumerate(works)]]
    return [x for x in found if x is not None] if start_until is not None else found


def all_or_raise(found: list[T | Exception]) -> list[T]:
    for x in found:
        if isinstance(x, Exception):
            raise x
    return found
