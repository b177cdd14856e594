"""A property-graph query, value-linking and evaluation engine on Spark.

Functions that run on executors are pickled by value: executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
