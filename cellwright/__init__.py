"""Spark-native data quality: profile, flag, repair, score and evaluate tables."""

import sys

from pyspark import cloudpickle

# Tasks get the helper functions with their closures, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
