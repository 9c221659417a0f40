"""Name -> query and name -> oracle SQL for the sequence engine."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir), with the DuckDB SQL of the same rows if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


from . import keyvalue_queries, sequence_queries  # noqa: E402, F401
