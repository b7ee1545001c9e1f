"""Retries with growing pauses, and a deadline, for reads outside Spark's own task retries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import SparkSession

from pantry.plans.errors import CatalogError, detail_of, reason_of

R = TypeVar("R")

ATTEMPTS, DEADLINE_S = 4, 15.0
BASE_DELAY_S = {"product": 0.5, "search": 1.0, "vocabulary": 0.5}
TRANSIENT = ("upstream_error", "upstream_timeout")


def with_retries(call: Callable[[], R], base: float = 0.5, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> R:
    """Tries again only after transient failures; the pause doubles."""
    for i in range(attempts):
        try:
            return call()
        except CatalogError as e:
            if e.reason not in TRANSIENT or i == attempts - 1:
                raise
            sleep(base * 2**i)
    raise AssertionError("unreachable")


def classified(call: Callable[[], R]) -> R:
    """Failures of a read as declared errors, by their kind and never by their message."""
    try:
        return call()
    except CatalogError:
        raise
    except (AnalysisException, ParseException) as e:
        raise CatalogError(reason_of(400), detail_of(str(e)) or "the request was refused") from e
    except TimeoutError as e:
        raise CatalogError(reason_of(None, timed_out=True), detail_of(str(e)) or "no answer in time") from e
    except (PySparkException, Py4JJavaError, OSError) as e:
        raise CatalogError(reason_of(None), detail_of(str(e)) or "the source failed") from e


def within(spark: SparkSession, call: Callable[[], R], seconds: float = DEADLINE_S, tag: str | None = None) -> R:
    """Runs a query under a deadline; its own Spark jobs, and no others, are cancelled when it passes. The same tag cancels it from outside."""
    tag = tag or f"pantry-{uuid.uuid4().hex}"

    def tagged() -> R:
        spark.sparkContext.addJobTag(tag)
        try:
            return call()
        finally:
            spark.sparkContext.removeJobTag(tag)

    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(tagged).result(timeout=seconds)
    except Late:
        spark.sparkContext.cancelJobsWithTag(tag)
        raise CatalogError("upstream_timeout", f"no answer within {seconds:g} s") from None
    finally:
        pool.shutdown(wait=False)
