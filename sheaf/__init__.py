"""sheaf: messy statistical files -> clean, catalogued, incrementally loaded Spark tables.

Column functions live in ``sheaf.functions``; DataFrame -> DataFrame transforms in
``sheaf.operators``; scans and the table/catalog store in ``sheaf.sources``;
composed flows and the registered queries in ``sheaf.plans``; Structured Streaming
jobs in ``sheaf.streaming``.
"""

__version__ = "0.1.0"

# Python code that runs inside tasks (grouped-map / map-in-pandas steps) must reach
# executors that do not have this package installed: ship it by value.
try:
    import sys as _sys

    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: ship with --py-files instead
    pass
