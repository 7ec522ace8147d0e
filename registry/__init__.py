"""Registered queries over the driver tables, each next to its equivalent plain SQL."""

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def load_all() -> None:
    from . import (calibration, catalog, intervals, quality, recording, report, scalars, sequences, sources,
                   stimuli, streams)  # noqa: F401
