"""Compositional-profile analytics written as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helper functions travel to the executors with the job; nothing needs installing there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
