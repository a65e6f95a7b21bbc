"""Operators for preparing training text and vectors, each working on whole tables.

Nothing outside this package imports it.  Functions that run inside Python tasks are shipped to the
workers by value, so executors need only the third-party libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
