"""Catalogue enrichment, search and recommendation as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so that executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
