"""lodestar: document retrieval and answer evaluation as Spark DataFrame jobs.

Every public operator is a function ``DataFrame -> DataFrame`` (or a column
expression).  There is no engine object and no global session; callers pass
their own ``SparkSession`` where one is needed.
"""

__version__ = "0.1.0"
