"""codelens: a PySpark-native engine for code intelligence and record checking.

Every public operator takes DataFrames (plus plain Python parameters) and
returns DataFrames.  Library code never calls ``collect()`` on unbounded data,
never talks to a network service, and keeps its core work in Spark SQL /
Catalyst.  See README.md for the operator inventory.
"""

__all__ = ["session"]
