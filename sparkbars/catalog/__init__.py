"""Registered queries over the driver's tables, each next to its SQL twin."""


def load():
    """(queries, SQL twins) by name."""
    from sparkbars.catalog import (  # noqa: F401
        bar_queries,
        event_queries,
        model_queries,
        stream_queries,
        trade_queries,
    )
    from sparkbars.catalog.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
