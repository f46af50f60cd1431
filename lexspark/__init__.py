"""A Spark-native engine for lexical retrieval, session logs and content lifecycle."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: nothing has to be installed or shipped there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
