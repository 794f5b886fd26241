"""Operators for large training-data pipelines, each by its named method.

Nothing else in the library imports this subpackage. ``catalog`` holds the
queries ``op1_...`` to ``op13_...`` and their SQL.

Functions of this subpackage are sent to executors by value, so that they need
not have the library installed."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
