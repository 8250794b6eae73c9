"""A PySpark-native analytics engine for conversations."""

import sys

from pyspark import cloudpickle

# Executors needn't have the package installed: functions of ours travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
