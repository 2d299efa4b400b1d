"""Recorded model runs on Spark: documents, cell series, seals, search, comparison."""

from importlib import import_module

_where = {
    "SealBrokenWarning": "errors", "TapeError": "errors", "Store": "sources.store", "watch": "recorder",
    "compare_runs": "operators.compare", "compare_query": "operators.compare", "find_runs": "plans.find", "to_dataframe": "operators.frame",
    "register": "functions.sql", "scan": "sources.checkpoints", "parse_trigger": "config",
}
__all__ = list(_where)


def __getattr__(name: str):
    """Names load when they are used, so that a worker that needs one operator imports no other."""
    if name not in _where:
        raise AttributeError(name)
    return getattr(import_module(f"tapelark.{_where[name]}"), {"compare_runs": "compare", "scan": "record"}.get(name, name))
