"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "entity_overview"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


from talkgrid.plans import build_queries, canon_queries, graph_queries, identity_queries, join_queries, ledger_queries, note_queries, review_queries, session_queries, signal_queries, stream_queries, text_queries, window_queries  # noqa: E402, F401
