"""paperlake: scanned-document analytics and corpus preparation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# tasks carry the helpers that they call, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
