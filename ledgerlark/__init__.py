"""A PySpark-native analytics engine for catalogue and public-ledger data."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
