"""weftline: a PySpark-native engine for point-annotated image collections.

Every operator is a function from DataFrames to DataFrames. Python functions
that do run on executors are shipped by value, so a cluster needs no install.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
