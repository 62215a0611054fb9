"""Analytics over protected columns, expressed as ordinary Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions that run there travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
