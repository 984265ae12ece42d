"""Population surface-and-colour analytics as Spark jobs over tables."""

import sys

from pyspark import cloudpickle

# Small numpy steps travel to the executors with the job, so nothing must be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
