"""Training-data operators. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions go to the executors with their code, so that these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
