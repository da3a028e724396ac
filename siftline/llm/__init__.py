"""Operators for building training corpora. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to tasks carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
