"""Operators that prepare training corpora; nothing else in the package imports them."""

import sys

from pyspark import cloudpickle

# Functions that tasks run travel with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
