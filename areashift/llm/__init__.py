"""Operators for preparing training data at scale, apart from the rest of the library.

Functions of this package travel to the workers with the job, so executors need numpy,
pyarrow and pandas but not the package itself.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
