"""Operators of a training-data pipeline (one module each) and their queries.

Functions of this package that run inside tasks travel to the executors by
value, so a cluster needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
