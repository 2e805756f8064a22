"""Complaint analytics on Spark: DataFrame-to-DataFrame operators over a register of
complaints, its event logs, embeddings and a policy corpus."""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
