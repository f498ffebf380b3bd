"""Tessera: curation, audit and corpus operators written for Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job, so that executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
