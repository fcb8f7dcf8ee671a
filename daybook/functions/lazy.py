"""Arrow UDFs that can be declared before a session exists: the type is parsed when the function is first applied."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from daybook.shared import bounded_batches


def arrow_udf(kind: str):
    """Where the function is applied, Arrow batches of the session are bounded: what a worker holds doesn't grow with a partition."""

    def declare(f):
        @wraps(f)
        def apply(*columns):
            bounded_batches(SparkSession.active())
            return F.pandas_udf(f, kind)(*columns)

        return apply

    return declare
