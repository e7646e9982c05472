"""lontar: a Spark-native engine for explainable linguistic analytics over tables of text."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
