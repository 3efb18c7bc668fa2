"""Operators for preparing training text and vectors, one module each."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
