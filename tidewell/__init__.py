"""Tidewell: text-corpus analytics for moderation data on Apache Spark.

Every operator is a plain function on DataFrames or Columns. Nothing here
starts a job by itself except where a docstring says so.
"""

__version__ = "0.1.0"
