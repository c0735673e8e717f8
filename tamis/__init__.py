"""tamis: curation of labelled datasets as Spark tables."""

import sys

from pyspark import cloudpickle

# Functions run in Arrow batches travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
