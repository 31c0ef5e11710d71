"""News articles on Spark: pages in, placed and grouped stories out.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing here runs a job unless its docstring says so.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
