"""Automated tabular analytics as Spark jobs: profile, clean, featurise, train, explain, score, monitor."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Partition functions travel to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
