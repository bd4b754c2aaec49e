"""vigil — transaction-risk analytics as Spark DataFrame jobs.

Every public operator is a ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions`` so Catalyst can push filters, prune columns and
fuse the work into whole-stage codegen.  The same column functions run in
batch jobs and in Structured Streaming queries.
"""

__version__ = "0.1.0"
