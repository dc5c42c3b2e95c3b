"""newslens: news-event analytics as plain PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel inside the job, so executors need no copy of this
# package and no path to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
