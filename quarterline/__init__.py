"""quarterline: report text and event data into regression-ready panels, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few vectorised functions travel to the executors with the plan, so the package need
# not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
