"""scarp: hazard-monitoring analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in executors travel with the job, so no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
