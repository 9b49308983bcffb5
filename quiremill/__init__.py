"""Document-corpus analytics on Spark: files, positioned text, tables, fonts and frames as DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run in Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
