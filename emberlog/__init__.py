"""Log analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors inside their tasks, so it needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
