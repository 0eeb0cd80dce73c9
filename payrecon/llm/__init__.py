"""Training-data operators: numbered jobs over `documents`, `pages`, `benchmark` and `labels`.

Nothing else in the library imports this subpackage. Its functions travel to the executors by value, so that
these need no copy of the library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
