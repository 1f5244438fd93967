"""eventlake: a PySpark-native engine for append-only event logs and lake tables."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: its functions travel to them whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
