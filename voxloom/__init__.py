"""Volumetric analytics as Spark tables and streams."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so that it needs
# to be installed on the driver alone
cloudpickle.register_pickle_by_value(sys.modules[__name__])
