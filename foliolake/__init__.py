"""foliolake: a Spark-native analytics engine for illustrated-page corpora."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
