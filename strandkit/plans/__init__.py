"""The registered queries and their SQL."""

import importlib

MODULES = ("sequence_queries", "omics_queries", "output_queries", "source_queries")


def _registry():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return importlib.import_module(f"{__name__}.registry")


def queries() -> dict:
    return dict(_registry().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_registry().SQL)
