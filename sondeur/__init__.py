"""Full-text retrieval and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code with them, so the workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
