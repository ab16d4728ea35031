"""PySpark-native analytics for agent memory: temporal facts, retrieval, graphs, patterns."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: the workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
