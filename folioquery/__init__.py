"""Document reconciliation, run inspection and quality review on Spark.

Functions that run on executors travel by value, so that workers need numpy and
pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
