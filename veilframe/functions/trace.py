"""Who asks: trace, request, tenant, user and address, carried along with the work and shown on Spark's jobs."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar, copy_context
from functools import wraps
from typing import Any

from pyspark.sql import SparkSession

from veilframe.errors import misconfigured

# What a context holds.
KEYS = ("traceId", "requestId", "tenantId", "userId", "clientIp")
_now: ContextVar[dict[str, str]] = ContextVar("trace", default={})


class TraceContext:
    """Inside a ``with`` block the given values stand beside or instead of those outside; afterwards those are back."""

    def __init__(self, **values: str):
        if unknown := set(values) - set(KEYS):
            raise misconfigured("GENERAL_FAILURE", f"no trace values {sorted(unknown)}")
        self.values = values

    @staticmethod
    def current() -> dict[str, str]:
        return dict(_now.get())

    def __enter__(self) -> TraceContext:
        self.before = _now.set({**_now.get(), **self.values})
        return self

    def __exit__(self, *_: Any) -> None:
        _now.reset(self.before)

    @staticmethod
    def tag(spark: SparkSession) -> None:
        """Marks the jobs that this thread starts from now on."""
        for key in KEYS:
            spark.sparkContext.setLocalProperty(f"veil.{key}", _now.get().get(key))


def carried(run: Callable) -> Callable:
    """The function as it runs under the context of this moment, in whatever thread it is called."""
    context = copy_context()

    @wraps(run)
    def inside(*args: Any, **options: Any) -> Any:
        return context.copy().run(run, *args, **options)

    return inside
