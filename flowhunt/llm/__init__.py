"""Operators for training-data pipelines; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Ship the task functions of all modules here by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
