"""Evaluation of retrieval and retrieval-augmented generation on Spark."""

import sys

from pyspark import cloudpickle

# tasks carry the package's functions with them, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
