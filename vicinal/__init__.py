"""vicinal: nearest-neighbour analytics and data preparation on Spark DataFrames."""

import os
import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# a task has one core; without this each Python worker's matrix products start a thread for every core of the machine
os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

# functions that run on executors go by value, so that workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
