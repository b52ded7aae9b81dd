"""Analytics over field archives on Spark: relational, graph, spatial and text operators as DataFrame programs."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions shipped to executors travel by value: workers need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
