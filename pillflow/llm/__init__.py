"""Operators for training-data pipelines; nothing else in the library imports them.

Functions that run inside tasks are sent to the executors by value, so that workers need not have this package on
their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
