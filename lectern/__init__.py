"""Lectern: analytics over document corpora as Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so that workers need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
