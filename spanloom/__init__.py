"""spanloom: span annotation and vocabulary mapping as Spark DataFrame jobs.

Every public operator is a function ``DataFrame(s) -> DataFrame`` built from
Spark SQL expressions, joins, windows and Structured Streaming, so it can be
chained with ``df.transform`` and planned by Catalyst.
"""

__version__ = "0.1.0"

# Functions run by Python workers (mapInPandas / applyInPandasWithState) are
# pickled by value, so executors need no installed copy of this package.
import sys as _sys

try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with addPyFile
    pass
