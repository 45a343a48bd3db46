"""Training-data operators. Nothing else in the library imports this subpackage.

The functions that run on executors travel by value, so that a cluster needs
no installed copy of the subpackage.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
