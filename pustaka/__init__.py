"""Spark-native analytics over a corpus of short documents and their provenance."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so that a cluster needs no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
