"""Contamination analytics for labelled benchmarks on Spark DataFrames."""

import sys as _sys

try:  # functions sent to executors carry their code, so that the package need not be installed there
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError):
    pass
