"""Sequence analytics and corpus preparation as DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so that executors need
# neither this package on their path nor a copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
