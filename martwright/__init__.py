"""Retail and marketing analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions run in Python workers travel with the job: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
