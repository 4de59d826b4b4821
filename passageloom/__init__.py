"""Passage retrieval, conversation and answer-scoring analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the UDFs that call them, so executors
# need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
