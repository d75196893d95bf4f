"""Registered queries: name -> (function of session and folder, DuckDB SQL or None)."""

from functools import wraps

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated query; ``sql`` may use the views of ``fixtures.VIEWS`` as common tables."""

    def keep(f):
        from tierstats.sources.fixtures import one_query, with_views

        @wraps(f)
        def run(s, d):
            with one_query():
                return f(s, d)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return keep
