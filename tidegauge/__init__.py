"""tidegauge: DataFrame operators for time-indexed inventory and demand data.

Python functions of this package that run inside Spark tasks are pickled by value, so executors
need only the libraries they call (numpy, pyarrow), not this package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
