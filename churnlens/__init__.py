"""churnlens: subscription and payments analytics as Spark DataFrame functions.

Sub-packages
------------
functions  column expressions (integer dates, decoding, buckets, map access)
operators  reusable relational building blocks (joins, aggregates, windows)
sources    readers for the driver tables, domain views, delimited text
plans      the user-level analyses (cohorts, partners, geo, payments)
"""

__version__ = "0.1.0"
