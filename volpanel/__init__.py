"""Panel forecasting and forecast evaluation as Spark jobs.

One panel row is one observation of one series on one day. Folds, horizons,
models and variants are columns, never Python loops, so one plan covers every
series of the panel.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
