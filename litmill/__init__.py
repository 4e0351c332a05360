"""litmill: build, resolve, rank and audit large evidence corpora with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Small helpers travel to the Python workers inside the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
