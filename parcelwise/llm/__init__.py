"""Training-data preparation: the operators, their queries and their SQL.

Nothing else in the library imports this package.
"""

import sys

from pyspark import cloudpickle

# the Python steps travel with their tasks, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
