"""reefline: Spark-native harmonisation and summaries of calcification measurements.

Four job families, each a DataFrame -> DataFrame operator set built on Spark SQL:
harmonise reported rates into standard units, summarise distributions, sweep
two-component mixtures, roll nested surveys up, and summarise posterior draws.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: a worker needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
