"""Operators for preparing training text at scale, and their registered queries.

Nothing else in the package imports this folder. ``load_all`` fills ``QUERIES`` and ``ORACLE``.
"""

from __future__ import annotations

from pyspark.cloudpickle import register_pickle_by_value

import clampspark

# Workers may start in another folder: send the Python helpers along with the job.
register_pickle_by_value(clampspark)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def load_all() -> None:
    from . import queries  # noqa: F401
