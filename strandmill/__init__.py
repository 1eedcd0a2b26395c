"""strandmill: alignment-free genome comparison and corpus preparation as Spark jobs.

Functions that run in Spark's Python workers travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
