"""PySpark-native analytics over spatial keys, map tiles, keyed streams and command logs."""
