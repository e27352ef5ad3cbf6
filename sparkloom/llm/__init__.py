"""Operators of large-scale training-data pipelines. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
