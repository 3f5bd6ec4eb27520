"""Operators for training-data pipelines, and their registered queries.

Nothing else in the library imports this package.  Functions that Spark sends
to Python workers are pickled by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
