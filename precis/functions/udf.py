"""Lazily built Arrow (pandas) UDFs.

Creating a ``pandas_udf`` at import time needs an active session, and the
module is imported again inside Python workers where none exists; the UDF
object is therefore built on first use on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class LazyPandasUDF:
    """Builds the Arrow UDF on first use and again whenever the active
    SparkContext changed (a UDF object is bound to the context it was first
    used with, so a stopped and restarted session needs a fresh one)."""

    def __init__(self, fn: Callable, return_type: str):
        self.fn = fn
        self.return_type = return_type
        self._udf = None
        self._ctx = None

    def __call__(self, *cols) -> Column:
        from pyspark import SparkContext
        ctx = SparkContext._active_spark_context
        if self._udf is None or ctx is not self._ctx:
            self._udf = self.make(self.fn, self.return_type)
            self._ctx = ctx
        return self._udf(*cols)

    @staticmethod
    def make(fn: Callable, return_type: str):
        return F.pandas_udf(fn, return_type)


class LazyArrowUDF(LazyPandasUDF):
    """The same for a function of Arrow arrays."""

    @staticmethod
    def make(fn: Callable, return_type: str):
        return F.arrow_udf(fn, return_type)


def pandas_fn(return_type: str):
    def deco(fn: Callable) -> LazyPandasUDF:
        return LazyPandasUDF(fn, return_type)
    return deco
