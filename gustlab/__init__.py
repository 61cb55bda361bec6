"""gustlab: wind-farm sensor and weather analytics as Spark DataFrame operators.

Subpackages: ``sources`` (readers and sinks), ``functions`` (column helpers, distribution tails),
``operators`` (reshape, quality, impute, joins, stats, timeseries, models, forecast, evaluate),
``plans`` (stand-in inputs from the driver tables, registered queries, workflows), ``streaming`` (empty).
"""

import sys as _sys

try:
    # Python tasks (pandas UDFs, mapInPandas) carry this package's functions by value, so executors need no
    # installed copy of it: nothing to ship with --py-files, nothing to import on the workers.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older pyspark
    pass
