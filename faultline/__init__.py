"""Incident analytics on Spark: telemetry in, evidence, reports and read models out."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
