"""Bulk checking and analysis of file conversions, as DataFrame, SQL and Structured Streaming operators."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks are sent whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
