"""Operators of a training-data pipeline. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with the job, whatever their import path is.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
