"""gridloom: a PySpark-native analytics engine for gridded and point-based geophysical data."""
