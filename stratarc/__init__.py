"""stratarc: web-archive capture analytics on PySpark.

Functions sent to executors are pickled by value, so that a cluster needs no
installed copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
