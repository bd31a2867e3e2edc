"""Spark-native analytics over property listings.

Every public function takes and returns DataFrames (or Columns) and never
creates a session of its own.
"""

__version__ = "0.1.0"
