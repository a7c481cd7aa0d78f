"""orrery: retrieval and corpus analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
