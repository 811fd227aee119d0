"""Electricity price panels and storage dispatch as Spark DataFrame programs.

The canonical table is the tidy panel ``(node STRING, timestamp TIMESTAMP_NTZ,
price DOUBLE)``. Every operator takes and returns DataFrames and stays lazy.
"""

import sys

from pyspark import cloudpickle

from pricepanel.battery import Battery

__all__ = ["Battery"]

# Functions that run in Python workers travel with the job, so the package needs
# no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
