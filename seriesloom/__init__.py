"""Panel forecasting and signal analytics as lazy Spark DataFrame jobs.

Every operator has the shape ``op(df, *, keys, date, cols, ...) -> DataFrame``:
it is pure, lazy and free of hidden I/O.  ``keys`` names the columns that
identify one series of the panel, ``date`` the column that orders it.
"""

import sys

from pyspark import cloudpickle

# The grouped-map functions travel to the executors with the helpers they
# call, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
