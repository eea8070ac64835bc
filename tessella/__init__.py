"""A PySpark-native engine for querying tables that live inside documents."""
