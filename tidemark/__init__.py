"""A select-project-join-sort engine on Spark DataFrames, with a column profiler.

Functions that run on executors are pickled by value, so a cluster whose Python lacks
this package can run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
