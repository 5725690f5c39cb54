"""energraph: a Spark-native engine for spreading-activation retrieval analytics."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
