"""Submitting independent jobs side by side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

Item = TypeVar("Item")
Result = TypeVar("Result")


def each(
    spark: SparkSession, job: Callable[[Item], Result], items: Iterable[Item], at_once: int = 4
) -> list[Result]:
    """``job`` of every item, in order.  The threads only submit; Spark does the work.

    If one fails, the others finish first and the error is raised then.
    """
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(job), item) for item in items]
    return [future.result() for future in futures]
