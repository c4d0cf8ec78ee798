"""Corpus and retrieval analytics as composable Spark DataFrame stages."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel by value, so that executors need no copy of this
# package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
