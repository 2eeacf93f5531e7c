"""Operators for preparing language-model training data.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Kernels travel to the Python workers by value: a cluster needs no copy of this package on its executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
