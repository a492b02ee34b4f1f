"""quillon: a Spark-native engine for evidence retrieval over paged documents.

Functions of this package that run inside Arrow or pandas stages are pickled by
value, so a cluster's Python workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
