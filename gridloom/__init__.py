"""gridloom: a PySpark-native analytics engine (steps, star models, cell functions, statistics)."""
