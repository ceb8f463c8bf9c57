"""Operators of a training-data pipeline.

Nothing outside this subpackage imports it. Its functions are pickled by value, so executors need no copy of
the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["gleanery"])
