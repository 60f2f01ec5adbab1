"""tidemark: change analysis over large collections of source files, on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a Column
expression builder) built from Spark SQL functions, window functions, joins
and Structured Streaming.  Python code runs inside tasks only for keyed
streaming state, for the pluggable completion client and for the file sink;
it is shipped by value, so executors need no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["session"]
