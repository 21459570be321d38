"""Operators for preparing training corpora: cleaning, near-copies, scoring, mixing and sharding."""

import sys

from pyspark import cloudpickle

# the functions that run inside tasks travel with the plan, so executors need numpy and pyarrow only
cloudpickle.register_pickle_by_value(sys.modules[__name__])
