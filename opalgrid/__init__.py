"""A PySpark-native analytics library for catalogued CRM-style tables."""
