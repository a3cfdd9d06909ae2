"""Size-abundance analytics for large forest inventories, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with their code, so executors need neither
# an installed copy of this package nor a shared working folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
