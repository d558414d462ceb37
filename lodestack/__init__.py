"""Case-outcome analytics on PySpark: operators over tables and streams of cases."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
