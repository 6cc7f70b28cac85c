"""Every operator as a named query over the given tables."""

import sys
from importlib import import_module

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODULES = ("rows", "tables", "joins", "aggregates", "maps", "samples", "scores", "streams")


def load() -> dict:
    for module in MODULES:
        import_module(f"registry.{module}")
    from registry.core import QUERIES

    return QUERIES
