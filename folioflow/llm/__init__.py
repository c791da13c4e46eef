"""Training-data operators: text, link and archive stages for large corpora.

Nothing outside this subpackage imports it. Python functions defined here are
shipped to executors by value, so a cluster needs no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
