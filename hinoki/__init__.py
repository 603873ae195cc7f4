"""hinoki: morphological text analysis as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Executors get the package's functions inside the tasks, so none of them needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
