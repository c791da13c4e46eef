"""Document-corpus analytics on Spark: profiling, scoring, grouping, pages and operational state.

Python functions of the package travel to executors by value, so a cluster
needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
