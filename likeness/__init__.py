"""likeness: profile tables, understand their columns and make look-alike data, on Spark."""

import sys

from pyspark import cloudpickle

# functions travel to the Python workers by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
