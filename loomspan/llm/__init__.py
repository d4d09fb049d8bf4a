"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Each module holds one operator with a
general interface; :mod:`loomspan.llm.queries` binds them to the test tables.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the task: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
