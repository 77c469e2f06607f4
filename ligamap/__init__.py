"""Spark-native contact-matrix and assembly-layout engine."""

import sys

from pyspark import cloudpickle

# Functions for Python workers carry their code along, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
