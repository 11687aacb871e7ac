"""verdictflow: findings-evaluation analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Python workers receive this package's functions by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
