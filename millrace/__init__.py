"""A catalog analytics and training-data engine on PySpark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
