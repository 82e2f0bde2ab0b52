"""Prepare, tokenize and evaluate large corpora of short structured strings on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors with the tasks that use them, so that
# nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
