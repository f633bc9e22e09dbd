"""tidewrack: a Spark-native engine for curating and analysing document corpora."""

import sys

from pyspark import cloudpickle

# Functions that workers run travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
