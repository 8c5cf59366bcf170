"""scoreline: two-sided contest analytics (league tables, prediction pools,
result-page extraction and tolerant file loading) expressed as Spark
DataFrame plans."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped by value, so executors need
# no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
