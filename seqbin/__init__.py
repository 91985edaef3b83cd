"""seqbin: reference-free grouping of short DNA reads on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from seqbin.params import BinningParams

# Functions that run in tasks are sent by value, so executors need no copy of
# this package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["BinningParams"]
