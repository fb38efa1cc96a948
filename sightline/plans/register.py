"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame. Times are read as UTC."""

    def wrap(f):
        @wraps(f)
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = re.sub(r'(?<!["\w])at(?!["\w])', '"at"', sql)  # a reserved word in DuckDB
        return run

    return wrap
