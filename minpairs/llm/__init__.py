"""Operators of a training-data pipeline: dedup, packing, quality, mixing, sharding."""

import sys

from pyspark import cloudpickle

# the code of Python tasks travels with them: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
