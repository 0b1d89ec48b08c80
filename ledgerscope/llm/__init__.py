"""Operators that prepare training text: extraction, filters, deduplication, sharding, mixing, tokens."""

import sys

from pyspark import cloudpickle

# The functions that run in Python workers travel with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
