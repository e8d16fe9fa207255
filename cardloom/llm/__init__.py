"""Operators for large-scale training-data pipelines; nothing else in the library imports them.

Functions that run inside tasks travel to the executors with their code, so that the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
