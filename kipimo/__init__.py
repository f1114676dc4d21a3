"""kipimo: evaluation analytics for language, speech and landmark models on Spark."""

import sys

from pyspark import cloudpickle

# UDF code travels inside the plan, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
