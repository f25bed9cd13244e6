"""Code-graph security analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the plan: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
