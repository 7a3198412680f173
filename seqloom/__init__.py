"""Suffix-link analytics for symbol and feature sequences on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the helpers with the task itself, so no install is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
