"""Operators for preparing training text. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the workers by value: these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
