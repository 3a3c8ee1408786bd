"""shotgrid: video annotation analytics on PySpark.

Nested annotation documents are read as DataFrames, flattened with
explode/higher-order functions, merged into chunks, probed with interval and
as-of joins, scored in batches and written to typed tables.
"""

__version__ = "0.1.0"
