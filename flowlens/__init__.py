"""Network-flow anomaly analytics as Spark DataFrame jobs.

Every public function takes a DataFrame and returns a DataFrame, a Column or a fitted ML
model. Rows are identified by an explicit key column, never by their position.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with their job, so that executors need no copy
# of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
