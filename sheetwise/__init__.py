"""Drawing-record analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python functions that run in tasks are shipped by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
