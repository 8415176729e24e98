"""Registered queries: every operator on the given tables, with its SQL twin."""

from importlib import import_module

MODULES = ("scans", "rows", "windows", "groups", "functions", "composites")


def load():
    """All registered queries and their SQL."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    from workload.registry import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
