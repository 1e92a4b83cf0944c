"""PySpark-native analysis of market price bars.

Every public function takes and returns DataFrames or Columns; nothing here
starts a session, collects a table or keeps state between calls.
"""
