"""Operators for large text corpora (training-data preparation).

Each module holds one operator; ``queries`` registers the thin query of each.
Nothing else in the library imports this subpackage.  Functions that run in
Python workers are pickled by value, so a worker needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
