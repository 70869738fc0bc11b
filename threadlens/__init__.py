"""threadlens: topic and engagement analytics over reader comments, on Spark.

Operators take and return DataFrames. ``sources`` reads and writes tables,
``functions`` holds column expressions, ``operators`` the reusable
relational and clustering operators, ``plans`` the jobs built from them
(engagement, report, users, model comparison, topic model).
"""

import sys

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """Ship this package's code inside the Python tasks (Arrow UDFs,
    mapInPandas, applyInPandas), so executors need not have it installed."""
    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # older cloudpickle: the package must be on the executors' path
        pass


_pickle_by_value()
