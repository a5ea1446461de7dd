"""lattiq: knowledge-graph quality analytics and record processing as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the task, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
