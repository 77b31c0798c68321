"""vistaspark: clinical-operations analytics as Spark DataFrame operators.

Every public operator is a pure function ``DataFrame(s) [+ plain args] -> DataFrame``
built from Spark's own expressions, so Catalyst can push filters into the scan,
prune columns and plan partial aggregation. Column names are arguments with
clinical defaults. No operator calls ``.master()`` or runs an action, except
ML fits and sinks.
"""

__version__ = "0.1.0"
