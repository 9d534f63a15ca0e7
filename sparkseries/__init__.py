"""Sensor time series on Spark: loading, schema work, layouts, queries and reports.

Every operator takes and returns DataFrames. The canonical wide table is
``time BIGINT`` (epoch milliseconds), ``deviceId STRING`` and one column per
sensor; operators accept other column names and timestamp types as arguments.
"""

TIME = "time"
TAG = "deviceId"
