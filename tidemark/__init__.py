"""Spark-native evaluation and run-record analytics."""

import sys

from pyspark import cloudpickle

# Functions and stateful processors travel to the Python workers by value, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
