"""asofloom: point-in-time feature synthesis and corpus operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so an executor needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"


def __getattr__(name):
    if name in ("Loom", "merge_groups", "tuned"):
        from . import loom

        return getattr(loom, name)
    if name in ("register_aggregation", "register_transformer", "get_aggregations", "get_transformers"):
        from .functions import aggregations, registry, transformations  # noqa: F401

        return getattr(registry, name)
    raise AttributeError(name)
