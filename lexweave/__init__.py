"""Spark-native engine: document collections in, evaluated knowledge graph out."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: they need numpy and the like there, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
