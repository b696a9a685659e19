"""Event-network and text-corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
