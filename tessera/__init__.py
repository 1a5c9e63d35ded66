"""A Spark-native text search and corpus-processing engine."""

import sys

from pyspark import cloudpickle

# Python workers get the functions themselves, so that they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
