"""A PySpark-native engine for tabular feature engineering and method comparison."""
