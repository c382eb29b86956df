"""Training-data operators: near-dedup, classifiers, decontamination, mixing and token output."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so that the package needn't be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
