"""Operators for preparing training text: scans, filters, searches, packing and sharding.

Nothing else in the library imports this subpackage. Functions that run in tasks travel by
value, so executors need numpy, pyarrow and the libraries named by each operator, but not
this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
