"""lensmap: map free-text feedback onto a catalogue of viewpoints, on Spark.

Every public operator is a function from DataFrame(s) to DataFrame.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Functions defined here run inside Python workers (Arrow / pandas UDFs).
# Ship them by value so executors need no copy of this package on their path.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
