"""A DataFrame engine for source-metadata flows and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions reach the executors by value, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
