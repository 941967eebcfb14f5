"""itemloom: item-bank analytics as composable Spark DataFrame operators.

Every operator takes DataFrames plus parameters and returns a DataFrame.  Nothing in
the library collects rows to the driver; Catalyst plans the work and AQE adapts it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions tasks run travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
