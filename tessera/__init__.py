"""tessera: a Spark-native engine for text collections with provenance."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
