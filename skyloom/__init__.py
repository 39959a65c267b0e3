"""skyloom: a Spark-native engine for integrating, reconciling and exploring large catalogs.

Everything is a function from DataFrames to a DataFrame or from Columns to a
Column; Catalyst and adaptive execution choose the physical plan.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
