"""A PySpark-native engine for detecting and explaining change in semi-structured documents."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
