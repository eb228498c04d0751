"""PySpark-native analytics over document knowledge graphs."""
