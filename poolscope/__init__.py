"""Market-context analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: what a task calls is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
