"""Spark-native data preparation for genomic, transcriptomic and text corpora."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel inside the job, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
