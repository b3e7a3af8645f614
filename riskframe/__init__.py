"""PySpark-native preparation, training and judging of binary classifiers.

Every public function takes and returns Spark DataFrames or Columns; see the
README for the module map.
"""
