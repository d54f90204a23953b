"""deltamesh: a PySpark-native engine that compares property graphs."""
