"""Spark-native preparation, scoring and reporting of prompt-rewriting data."""

import sys

from pyspark import cloudpickle

# Helpers used inside Python tasks travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
