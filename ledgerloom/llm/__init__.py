"""Training-data operators: each module holds one operator with its own general interface."""

import sys

from pyspark import cloudpickle

# Task functions of this subpackage travel with the job, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
