"""weekloom: weekly product demand preparation and forecasting on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from weekloom.config import ForecastConfig

# The few Python functions that run in executors travel with their task, so a cluster needs no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ForecastConfig"]
