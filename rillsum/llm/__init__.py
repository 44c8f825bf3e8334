"""Operators of a large-scale training-data pipeline.  Nothing outside this package imports it.

Functions that run on executors are shipped by value, so the executors need not have this package.
"""

from pyspark import cloudpickle

import rillsum

cloudpickle.register_pickle_by_value(rillsum)
