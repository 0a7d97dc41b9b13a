"""Operators for large-scale training-data pipelines."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with them; executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
