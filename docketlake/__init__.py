"""Document inventories and training data on Spark."""

import os

from pyspark import SparkContext

# Python workers on this machine import the library from where the driver did, whatever its working directory.
_root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if _root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [_root, os.environ.get("PYTHONPATH")]))
    if SparkContext._active_spark_context is not None:
        SparkContext._active_spark_context.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
