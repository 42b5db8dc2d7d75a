"""Location retrieval and corpus preparation as Spark jobs."""

import sys

from pyspark.cloudpickle import cloudpickle

# Functions of this package travel to the workers by value, so that these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
