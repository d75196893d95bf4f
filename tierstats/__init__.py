"""tierstats: repeated-measurement tables and corpus operators as plain Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: what they run is sent by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
