"""Point-in-time panel analytics as plain functions over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
