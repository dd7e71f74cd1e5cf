"""Log analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# ship the package's functions with the tasks, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
