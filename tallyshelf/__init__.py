"""Catalogue, review and usage analytics as distributed DataFrame jobs.

Functions of this package travel to the executors by value, so that workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
