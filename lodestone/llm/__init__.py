"""Operators for training-data pipelines; nothing else in the library imports them.

Functions that run on executors are pickled by value, so that executors need no copy of
the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
