"""velumra: graph, vector, text and training-data operators as Spark DataFrame plans.

Functions that run on executors are pickled by value, so a cluster needs no
installed copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
