"""strandloom: a PySpark-native engine for barcoded sequencing reads and relational tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors with their code, so that workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
