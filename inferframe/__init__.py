"""A Spark engine for batch language-model inference and the data processing around it."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions by value, so that it needn't be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
