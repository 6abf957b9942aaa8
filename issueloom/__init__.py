"""Issue analytics on Spark: from landed articles to ranked issues and summaries."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
