"""Differentially private analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so that a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
